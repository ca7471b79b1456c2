"""The stream of new items by section, over restarts, against a batch."""

from collections import defaultdict

from weftline.streaming import sections


def test_flushes_over_restarts(spark, tmp_path):
    folder, root = f"{tmp_path}/landing", f"{tmp_path}/root"
    schema = "section string, item string, run string"
    parts = [
        [("a", f"i{k}", "r1") for k in range(7)] + [("b", "x", "r1"), (None, "n", "r1")] * 2,
        [("a", f"i{k}", "r1") for k in range(25)] + [("b", None, "r1")],
        [("a", None, "r1"), ("b", "x", "r2"), ("b", "y", "r2"), ("b", None, "r2"), (None, None, "r1"), ("c", None, "r1")],
    ]
    found = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        found.append(sections.run_available(spark, folder, root).collect())
    sizes = [sorted((r["section"], r["flush"], len(r["items"]), r["ended"]) for r in rows) for rows in found]
    assert sizes[0] == []
    assert sizes[1] == [("a", 1, 10, False), ("a", 2, 10, False), ("b", 1, 1, True)]
    assert sizes[2] == [("", 1, 1, True), ("a", 1, 10, False), ("a", 2, 10, False), ("a", 3, 5, True), ("b", 1, 1, True), ("b", 2, 1, True)]
    seen, batch = defaultdict(list), defaultdict(set)
    for r in found[-1]:
        seen[r["section"]] += r["items"]
    for section, item, _ in (r for rows in parts for r in rows):
        if item:
            batch[section or ""].add(item)
    assert {s: sorted(items) for s, items in seen.items()} == {s: sorted(items) for s, items in batch.items()}
    assert len(sections.run_available(spark, folder, root).collect()) == len(found[-1])  # nothing new came


class State:
    """What a section's state is, without a stream."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timer = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timer = ms


def test_silent_sections_are_flushed_by_a_timer():
    import pandas as pd

    update, state = sections._flush(3, 500), State()
    rows = pd.DataFrame({"item": ["b", "a"], "ended": [False, False]})
    assert [len(f) for f in update(("s",), iter([rows]), state)] == [0] and state.value == (["a", "b"], 0) and state.timer == 500
    late = State(state.value, timed_out=True)
    out = next(update(("s",), iter([]), late))
    assert out.to_dict("records") == [{"section": "s", "flush": 1, "items": ["a", "b"], "ended": True}] and late.value == ([], 1) and late.timer is None
