"""Analytics over large music catalogs on Spark: DataFrame in, DataFrame out."""
