"""Table operators that Spark does not ship: exact distributed ranks and quantiles, sampling, key checks."""
