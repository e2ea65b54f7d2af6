"""credence: news-credibility analytics as Spark DataFrame operators."""
