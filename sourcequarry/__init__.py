"""Code-corpus analytics on Spark: source files in; facts, graphs, prompts, cached answers and reports out."""
