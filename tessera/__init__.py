"""tessera: a Spark-native document intelligence engine (see README.md)."""
