"""blobsight: firmware-vulnerability analytics and corpus preparation on Spark DataFrames."""
