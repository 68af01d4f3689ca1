"""medcorpus: PySpark jobs that prepare and judge fine-tuning data."""
