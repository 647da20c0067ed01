"""Analytics over typed, nested, time-stamped event recordings, written as Spark jobs."""
