"""quire: document corpora, their versions and their annotations as Spark dataflow."""
