"""churnlake: customer-churn analytics as PySpark DataFrame operators."""
