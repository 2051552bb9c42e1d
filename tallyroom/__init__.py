"""Product analytics over app events, subscriptions and profiles, on Spark.

Every operator takes DataFrames plus an explicit ``as_of`` moment and returns
a DataFrame; nothing is collected on the driver.
"""
