"""Spark-native analytics over cohorts of multichannel series and the weighted networks derived from them."""
