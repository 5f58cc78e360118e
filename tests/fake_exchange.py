"""A client that the paged source can import: pages of three bars."""


def klines(symbol, since):
    start = (since + 9) // 10 * 10
    return [[t, 1.0, 2.0, 0.5, float(t), 1.0] for t in range(start, min(start + 30, 100), 10)]
