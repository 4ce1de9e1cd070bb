from tidemark.operators import book

EVENTS = "instrument long, ts long, sequence long, action string, side string, order_id long, price double, size double"


def test_rules_and_depth(spark):
    rows = [
        (1, 1, 1, "ADD", "B", 1, 99.0, 10.0),
        (1, 2, 1, "ADD", "A", 2, 101.0, 5.0),
        (1, 3, 1, "ADD", "B", 3, 101.5, 1.0),
        (1, 4, 1, "ADD", "B", 1, 98.0, 1.0),
        (1, 5, 1, "FILL", "B", 1, 99.0, 4.0),
        (1, 6, 1, "ADD", "B", 4, 99.0, 2.0),
        (1, 7, 1, "MODIFY", "B", 4, 98.0, 3.0),
        (1, 8, 1, "TRADE", "B", 9, 99.0, 4.0),
        (1, 9, 1, "CANCEL", "A", 7, 0.0, 0.0),
        (1, 10, 1, "CANCEL", "A", 2, 0.0, 0.0),
        (2, 1, 1, "CLEAR", "B", 0, 0.0, 0.0),
    ]
    got = {(r["instrument"], r["ts"]): r for r in book.depth(spark.createDataFrame(rows, EVENTS)).collect()}
    assert [got[1, t]["error"] for t in range(1, 11)] == [None, None, "crossed book", "duplicate order", None, None, None, None, "unknown order", None]
    assert (got[1, 5]["bid_px"], got[1, 5]["bid_sz"], got[1, 5]["ask_px"]) == (99.0, 6.0, 101.0)
    assert [tuple(x) for x in got[1, 10]["bids"]] == [(99.0, 6.0), (98.0, 3.0)] and got[1, 10]["ask_px"] is None
    assert got[2, 1]["bids"] == []
