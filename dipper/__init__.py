"""Search for periodic box-shaped dips in brightness time series, as composable Spark DataFrame functions."""
