"""A Spark-native engine that finds, places and masks personal data in documents."""
