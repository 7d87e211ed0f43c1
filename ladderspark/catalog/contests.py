from ladderspark.catalog.base import query, with_results
from ladderspark.plans import contests


@query(with_results("SELECT * FROM results"))
def contest_results(spark, sf):
    return contests.results(spark, sf)
