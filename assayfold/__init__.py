"""Spark-native judgement, triage and calibration analytics, with training-data operators beside them."""
