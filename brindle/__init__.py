"""PySpark-native analytics for cohorts of dense numeric arrays and the tables that describe them."""
