"""Text rules of the catalogue: keys, angles, keywords, durations, urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword patterns, first match in this order wins (fixed values).
KEEP_PATTERNS = [
    r"\bjab\b", r"\bpunch(ing|er)?\b", r"\bbox(ing|er)?\b", r"muay[ -]?thai", r"kickbox(ing|er)?", r"\bmma\b", r"martial[ -]?art",
    r"\bstrike\b", r"\bstrik(ing|er)?\b", r"left[ -]?hook", r"right[ -]?hook", r"\bhook\b", r"\buppercut\b",
    r"\bcross\b.*punch|punch.*\bcross\b", r"one[-\s]two", r"\bcombo\b", r"slow[ -]?motion.*punch|punch.*slow[ -]?motion",
    r"how to (throw|land|throw a|punch)", r"boxing (technique|form|lesson|tutorial|training|drill|fundamentals)",
    r"(technique|tutorial|form|mechanic|drill).*punch", r"southpaw", r"orthodox (stance|style|boxing)", r"fighting stance",
    r"\bknockout\b", r"\bko\b", r"sparring", r"boxing workout", r"boxing (for|class|camp)",
]
REJECT_PATTERNS = [
    r"time[ -]?lapse", r"timelapse", r"\bcaterpillar\b", r"\bbutterfly\b", r"\bpeanut\b", r"\bplant\b",
    r"growing (plant|seed|flower|vegetable)", r"\bcricket\b", r"\bbasketball\b", r"\bnba\b", r"\bnfl\b", r"chess", r"rubik",
    r"long[ -]?jump", r"high[ -]?jump", r"triple[ -]?jump", r"\bgoal\b.*soccer|soccer.*\bgoal\b", r"\bsoccer\b",
    r"\bfootball\b(?!.*box)", r"\bbaseball\b", r"\bhockey\b", r"\btennis\b", r"ping[ -]?pong", r"\bvolleyball\b", r"\bswimming\b",
    r"\bgolf\b", r"\bcycling\b", r"lamelo", r"kohli|virat", r"minecraft", r"\bgaming\b", r"\bfortnite\b", r"dance|dancing",
    r"cooking|recipe|food", r"makeup|beauty", r"prank", r"magic trick", r"rubix|magic cube", r"water.*fast(er|est)|fast(er|est).*water",
]

# Words that carry no meaning in a title slug (fixed values).
SLUG_STOP_WORDS = ["the", "a", "an", "to", "how", "in", "of", "for", "and", "with", "by", "on", "your", "this", "that", "perfect", "boxing",
                   "jab", "shorts", "tutorial", "technique"]

# View tokens in the order they are tried (fixed values).
VIEW_TOKENS = [
    ("left45", ["southpaw", "lead hand", "lead jab", "right lead"]),
    ("right45", ["orthodox", "rear side", "right hand stance", "left lead"]),
    ("lead_side", ["footwork", "pivot", "stance", "body", "mechanics", "step", "hip"]),
    ("behind", ["behind", "from behind", "rear view", "back view"]),
    ("side_right", ["right side", "right profile", "side right", "from right"]),
    ("side_left", ["left side", "left profile", "side left", "from left"]),
]

# Angle names inside file names, in the order they are tried; a trailing pattern entry is a bounded word (fixed values).
ANGLE_TOKENS = [
    ("behind", ["behind", "rear", "back"]), ("left45", ["left45", "45left", "45_left", "left_45"]),
    ("right45", ["right45", "45right", "45_right", "right_45"]), ("side_left", ["side_left", "left_side"]),
    ("side_right", ["side_right", "right_side"]), ("front", ["front"]),
]
ANGLE_WORDS = [("side_left", "left"), ("side_right", "right")]
SIDE_TOKENS = ["side", "profile"]

ANGLE_TEXTS = {"front": "front view", "left45": "left 45 degree view", "right45": "right 45 degree view", "side_left": "side left view",
               "side_right": "side right view", "side": "side view", "behind": "back view"}

# Search phrases per technique (fixed values).
QUERY_TEMPLATES = {
    "jab": ["boxing jab tutorial {angle}", "how to throw a jab {angle}", "jab technique {angle} view", "boxing jab form slow motion {angle}",
            "proper jab mechanics {angle}"],
    "cross": ["boxing cross punch tutorial {angle}", "how to throw a cross {angle}", "cross punch technique {angle} view",
              "boxing cross form {angle}", "power cross boxing {angle}"],
    "hook": ["boxing hook punch tutorial {angle}", "how to throw a hook {angle}", "hook punch technique {angle} view",
             "boxing hook form {angle}", "power hook boxing {angle}"],
    "uppercut": ["boxing uppercut tutorial {angle}", "how to throw an uppercut {angle}", "uppercut technique {angle} view",
                 "boxing uppercut form {angle}", "power uppercut {angle}"],
    "front kick": ["karate front kick tutorial {angle}", "how to throw a front kick {angle}", "front kick technique {angle} view",
                   "martial arts front kick {angle}", "proper front kick form {angle}"],
    "roundhouse kick": ["karate roundhouse kick tutorial {angle}", "how to throw a roundhouse kick {angle}",
                        "roundhouse kick technique {angle} view", "martial arts roundhouse kick {angle}", "proper roundhouse kick form {angle}"],
    "side kick": ["karate side kick tutorial {angle}", "how to throw a side kick {angle}", "side kick technique {angle} view",
                  "martial arts side kick {angle}", "proper side kick form {angle}"],
    "fighting stance": ["boxing fighting stance tutorial {angle}", "martial arts fighting stance {angle}",
                        "fighting stance technique {angle} view", "proper boxing stance {angle}", "martial arts stance form {angle}"],
}
GENERIC_TEMPLATES = ["{technique} tutorial {angle}", "how to {technique} {angle}", "{technique} technique {angle}"]


def normalize_key(text: Column, camel: bool = True, underscore: bool = True) -> Column:
    """Words in lower case joined by ``_``. ``camel`` splits CamelCase; without ``underscore`` existing ones stay."""
    t = F.coalesce(text, F.lit(""))
    if camel:
        t = F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "[-_]" if underscore else "-", " ")
    return F.regexp_replace(F.regexp_replace(F.lower(t), r"^\s+|\s+$", ""), r"\s+", "_")


def split_reference_key(key: Column) -> tuple[Column, Column]:
    """Technique and angle (NULL when absent) of ``technique__angle``."""
    parts = F.split(F.trim(key), "__", 2)
    return normalize_key(F.get(parts, F.lit(0))), F.when(F.size(parts) > 1, normalize_key(F.get(parts, F.lit(1))))


def infer_angle(name: Column) -> Column:
    t = F.lower(name)
    rules = [(F.greatest(F.lit(False), *[F.contains(t, F.lit(w)) for w in words]), angle) for angle, words in ANGLE_TOKENS]
    rules += [(F.rlike(t, F.lit(rf"(^|[_\-.\s]){word}($|[_\-.\s])")), angle) for angle, word in ANGLE_WORDS]
    rules.append((F.greatest(*[F.contains(t, F.lit(w)) for w in SIDE_TOKENS]), "side"))
    out = F.when(*rules[0][:1], rules[0][1])
    for cond, angle in rules[1:]:
        out = out.when(cond, angle)
    return out


def fallback_angle(name: Column) -> Column:
    stem = F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "clip").otherwise(slug)


def first_match(text: Column, patterns: list[str]) -> Column:
    """First pattern of the list found anywhere in the text, without regard to case."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(f"(?i){p}")), F.lit(p)) for p in patterns])


def classify_keywords(title: Column, tags: Column, notes: Column | None = None, keep: list[str] | None = None,
                      reject: list[str] | None = None) -> Column:
    """struct(decision, pattern): reject words on title, tags and notes first, then keep words on title and tags."""
    blank = lambda c: F.when(c == "", F.lit(None).cast("string")).otherwise(c)
    main = F.concat_ws(" ", blank(title), blank(tags))
    full = F.concat_ws(" ", blank(title), blank(tags), blank(notes)) if notes is not None else main
    bad, good = first_match(full, reject or REJECT_PATTERNS), first_match(main, keep or KEEP_PATTERNS)
    return F.struct(F.when(bad.isNull() & good.isNotNull(), "yes").otherwise("no").alias("decision"), F.coalesce(bad, good).alias("pattern"))


def iso_duration_seconds(text: Column) -> Column:
    """Whole seconds of PT#H#M#S; 0 when the text is anything else."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.\d+)?S)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0).cast("bigint"))
    return part(1) * 3600 + part(2) * 60 + part(3)


def video_id(url: Column) -> Column:
    """Path of a short link, else the v parameter, else empty."""
    short = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+|/+$", "")
    param = F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))
    return F.coalesce(F.when(F.try_parse_url(url, F.lit("HOST")) == "youtu.be", short).otherwise(param), F.lit(""))


def slug_words(text: Column, n: int = 4) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(SLUG_STOP_WORDS))
    return F.array_join(F.slice(kept, 1, n), "_")


def view_bucket(text: Column) -> Column:
    t = F.lower(text)
    out = None
    for angle, words in VIEW_TOKENS:
        cond = F.greatest(*[F.contains(t, F.lit(w)) for w in words])
        out = F.when(cond, angle) if out is None else out.when(cond, angle)
    return out.otherwise("front")


def truthy(text: Column, words=("1", "true", "yes", "y", "keep")) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(list(words))


def to_float(text: Column, default: float | None = None) -> Column:
    v = F.trim(text).try_cast("double")
    good = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return F.coalesce(good, F.lit(default)) if default is not None else good


def to_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(default).cast("bigint"))


def split_urls(*cells: Column) -> Column:
    """Distinct sources of one or more cells, in order of appearance."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), r"[\n,;|]+") for c in cells]))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def compact_text(text: Column, n: int = 52) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), " +", " ")
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def clean_str(text: Column) -> Column:
    """Special characters become underscores."""
    return F.regexp_replace(text, r"[|@#!¡·$€%&()=?¿^*;:,¨`><+]", "_")


def expand_queries(technique: Column, angle: Column, n: int = 5) -> Column:
    """Search phrases of a technique seen from an angle; generic ones for unknown techniques."""
    name = F.regexp_replace(normalize_key(technique), "_", " ")
    text = F.coalesce(*[F.when(angle == a, F.lit(t)) for a, t in ANGLE_TEXTS.items()], angle)
    known = F.create_map(*[x for k, v in QUERY_TEMPLATES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    templates = F.coalesce(F.try_element_at(known, name), F.array(*[F.lit(t) for t in GENERIC_TEMPLATES]))
    filled = F.transform(F.slice(templates, 1, n), lambda t: F.trim(F.replace(F.replace(t, F.lit("{angle}"), text), F.lit("{technique}"), name)))
    return F.array_distinct(filled)
