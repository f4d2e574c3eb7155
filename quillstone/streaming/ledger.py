"""A budget ledger whose state lives across batches of a stream, and the same over a table.

Rows are reservations, commits and rollbacks of a scope and day. A reservation is admitted while what is
committed and reserved stays within the cap; a commit turns one into what it really cost, a rollback frees it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, time, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROWS = "scope string, day date, at timestamp, id long, kind string, amount double, outcome string, committed double, reserved double"
STATE = "committed double, ids array<long>, amounts array<double>"
#: Rows of one moment: first what frees or settles, then what asks, each by its id.
ORDER = {"rollback": 0, "commit": 1, "reserve": 2}


class Account:
    """What a scope has committed on a day, and its open reservations by id."""

    def __init__(self, committed: float = 0.0, ids: list[int] = (), amounts: list[float] = ()):
        self.committed, self.open = committed, dict(zip(ids, amounts))

    def apply(self, kind: str, number: int, amount: float | None, cap: float) -> str:
        held = sum(self.open.values())
        if kind == "reserve":
            if number in self.open:
                return "repeated"
            if amount is None or self.committed + held + amount > cap:
                return "refused"
            self.open[number] = amount
            return "admitted"
        if number not in self.open:
            return "unknown"
        own = self.open.pop(number)
        if kind == "commit":
            self.committed += own if amount is None else amount
            return "committed"
        return "rolled back"

    def state(self) -> tuple:
        return self.committed, list(self.open), list(self.open.values())


def decide(account: Account, rows: pd.DataFrame, cap: float) -> pd.DataFrame:
    """rows, in their order, with outcome, committed and reserved after each."""
    ordered = rows.assign(__o=rows["kind"].map(ORDER)).sort_values(["at", "__o", "id"], kind="stable").drop(columns="__o")
    told = []
    for kind, number, amount in zip(ordered["kind"], ordered["id"], ordered["amount"]):
        outcome = account.apply(kind, int(number), None if pd.isna(amount) else float(amount), cap)
        told.append((outcome, account.committed, sum(account.open.values())))
    outcome, committed, reserved = zip(*told) if told else ((), (), ())
    return ordered.assign(outcome=list(outcome), committed=list(committed), reserved=list(reserved))


COLUMNS = ["scope", "day", "at", "id", "kind", "amount"]


def streamed(rows: DataFrame, cap: float, late: str = "1 day") -> DataFrame:
    """The ledger of a stream: rows plus outcome, committed, reserved; state is kept per scope and day.

    rows: scope, day, at (timestamp), id, kind (reserve, commit, rollback), amount. Rows of one batch are taken in
    the order of their times. A day's account is given up when the watermark, late behind the latest time, has passed
    its end; rows that are older than the watermark are dropped, as everywhere in a stream. A restarted stream goes on
    from its checkpoint: no row is told twice.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        account = Account(*state.get) if state.exists else Account()
        yield decide(account, pd.concat(list(parts)), cap)
        state.update(account.state())
        end = datetime.combine(key[1], time(), timezone.utc) + timedelta(days=1)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    timed = rows.select(*COLUMNS).withWatermark("at", late)
    return timed.groupBy("scope", "day").applyInPandasWithState(run, ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settled(rows: DataFrame, cap: float) -> DataFrame:
    """The same over a table: rows are dealt by scope and day, sorted (with spill) and streamed through the account."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, account = None, Account()
        for pdf in batches:
            for group, part in pdf.groupby(["scope", "day"], sort=False, dropna=False):
                own = tuple(None if pd.isna(x) else x for x in group)
                if own != key:
                    key, account = own, Account()
                yield decide(account, part.drop(columns="o"), cap)

    order = "case kind when 'rollback' then 0 when 'commit' then 1 else 2 end as o"
    dealt = rows.selectExpr(*COLUMNS, order).repartition("scope", "day").sortWithinPartitions("scope", "day", "at", "o", "id")
    return dealt.mapInPandas(run, ROWS)
