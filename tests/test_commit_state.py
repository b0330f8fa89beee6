"""State of the commits: intervals in order, so that a row looks up its own words."""

from __future__ import annotations

import pandas as pd

from spanlock.streaming import commits as C


class _State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_committed_intervals_are_kept_in_order_so_that_one_look_is_enough():
    columns = [c.split()[0] for c in C.READY.split(", ")]
    state, rows = _State(), [(1, 5, 6, "a", 1, 0.9, 0.9), (1, 1, 2, "a", 1, 0.8, 0.8), (1, 2, 3, "a", 2, 0.9, 0.9), (1, 3, 4, "b", 2, 0.7, 0.7), (1, 6, 9, "b", 2, 0.6, 0.6)]
    out = pd.concat(C._commit((1,), iter([pd.DataFrame(rows, columns=columns)]), state))
    assert list(zip(out["start_word"], out["phase"])) == [(5, "live"), (1, "live"), (3, "live")]
    assert tuple(map(list, state.get[1:])) == ([1, 3, 5], [2, 4, 6])
    late = pd.concat(C._commit((1,), iter([pd.DataFrame([(1, 7, 8, "a", 3, 0.9, 0.9), (1, 9, 9, "a", 2, 0.9, 0.9)], columns=columns)]), state))
    assert sorted(zip(late["start_word"], late["phase"])) == [(7, "live"), (9, "late")]
