"""Network-threat analytics as composable PySpark DataFrame operators."""
