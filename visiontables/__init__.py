"""Vision tables: detections, tracks, poses, labels and catalogues as Spark DataFrames."""
