import datetime
import random


def make_bars(spark, sizes, seed=1, gaps=True):
    rng, rows = random.Random(seed), []
    for symbol, n in sizes.items():
        day = datetime.date(2000, 1, 1)
        for _ in range(n):
            day += datetime.timedelta(days=rng.choice([1, 1, 3, 90]) if gaps else 1)
            o, h, lo, c = (round(rng.uniform(1, 9), 2) for _ in range(4))
            rows.append((symbol, day, o, h, lo, c, rng.randrange(1000)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume long")
