"""gatewell: policy-gated record processing and training-data operators on Spark DataFrames."""
