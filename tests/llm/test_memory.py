"""What Python workers hold while they work and once a task has ended."""

import tracemalloc

import attnlens.llm.common as common
from attnlens.llm import toxicity


def rows_of(n):
    """Every toxic row has one word of its kind; other rows have words of their own."""
    return [(f"badword{k % 3} common w{k}", 1) for k in range(60)] + [(" ".join(f"x{k}y{m}" for m in range(40)), 0) for k in range(n)]


def peak(rows):
    tracemalloc.start()
    try:
        toxicity.mine(rows)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_mining_does_not_hold_words_that_no_toxic_row_has():
    assert peak(rows_of(4000)) < 2 * peak(rows_of(400))
    # the starts of "badword0", the two strong ones shared by all rows of a kind included
    assert {b"badword0", b"badword1", b"badword2", b"bad*", b"badwor*", b"common"} <= set(toxicity.mine(rows_of(50)))


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    out = common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(out) == 2 and not calls
    assert list(out) == [3] and calls == [1]
