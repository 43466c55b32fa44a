"""A Spark-native engine for series of images and the vector fields computed from them."""
