"""Log-timeline and artefact-triage analytics on Spark DataFrames."""
