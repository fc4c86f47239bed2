"""pairloom: Spark-native curation of text pairs and evaluation of retrieval over them."""
