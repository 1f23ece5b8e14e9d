"""Small frames for tests."""


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, t string")
