"""Log-template analytics on Spark: mining templates from log lines, and matching lines against them."""
