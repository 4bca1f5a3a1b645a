"""venuelake: a Spark-native analytics engine for lead and venue intelligence."""
