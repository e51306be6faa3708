"""MLlib models and series jobs: churn and remaining-LTV models on temporal snapshots,
daily revenue forecasting and anomaly flags."""
