"""Gap sessionisation: clicks of a client become sessions, in lockstep over numpy arrays.

Clicks are dealt by range of (client, time, id), so that a busy client is spread over many tasks. A certain break (another
client, a final click before, a long gap) starts an island of clicks; inside an island only the length rule cuts. All islands
of a batch advance together, one session a step: a search in one ascending key of island and time gives each island's next
session. What a task cannot know is how its first island began: the clicks up to the task's first certain break are put
aside and cut once the session that reaches into the task is known. That session follows from one short row a task, and where an island
spans whole tasks from tables (time of the first cut -> last session) that are composed in pairs, in logarithmic rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch, stage_path, stage_table, write_stage

MINUTE = 60_000_000


@dataclass(frozen=True)
class Rules:
    """Times in microseconds."""

    gap: int = 5 * MINUTE
    length: int = 120 * MINUTE
    late_minutes: int = 60


#: Ids of an open session that are kept before they are put down as a piece of its path.
PIECE_IDS = 1 << 16
DONE, PIECE, LEAD, TASK = range(4)
#: Stands for a task after the last.
AFTER_ALL = 1 << 30
ROW = (
    "kind int, part int, seq long, client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, "
    "value_cents long, reason string, final boolean, path string, digest binary, rows binary"
)
ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((n, pa.int64()) for n in ("seq", "client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents")), ("reason", pa.string()), ("final", pa.bool_()), ("path", pa.string()), ("digest", pa.binary()), ("rows", pa.binary())])
#: One click of the rows put aside.
CLICK = np.dtype([("client", "<i8"), ("us", "<i8"), ("id", "<i8"), ("cents", "<i8"), ("late", "?"), ("final", "?")])


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


@dataclass(frozen=True)
class Known:
    """What a click must know of those before it: the last timely click and the session that it is in."""

    client: int
    us: int
    final: bool
    start: int
    session: int


def certain_breaks(c: np.ndarray, before: Known | None, rules: Rules) -> np.ndarray:
    """Which timely clicks start a session whatever session came before; before: the last click ahead of them."""
    out = np.ones(len(c), dtype=bool)
    out[1:] = (c["client"][1:] != c["client"][:-1]) | c["final"][:-1] | (c["us"][1:] - c["us"][:-1] >= rules.gap)
    if len(c) and before is not None:
        out[0] = c["client"][0] != before.client or before.final or c["us"][0] - before.us >= rules.gap
    return out


def session_starts(us: np.ndarray, hard: np.ndarray, start: int | None, rules: Rules) -> np.ndarray:
    """Which clicks start a session. start: time of the session that the first click continues, if it is no certain break.

    One ascending key holds all islands, apart by more than a session's length, so one search finds every island's next
    session; islands without one leave.
    """
    n = len(us)
    mark = hard.copy()
    first = np.flatnonzero(np.r_[True, hard[1:]]) if n else np.zeros(0, dtype=np.int64)
    if not n:
        return mark
    ends = np.r_[first[1:], n]
    base = np.r_[0, np.cumsum(us[ends - 1] - us[first] + rules.length + 1)[:-1]]
    island = np.cumsum(np.r_[0, hard[1:]])
    key = us - us[first][island] + base[island]
    pos, stop = first, ends
    if not hard[0]:
        begin = int(np.searchsorted(key, start - us[0] + rules.length, "right"))
        if begin < ends[0]:
            mark[begin] = True
            pos = np.r_[begin, first[1:]]
        else:
            pos, stop = first[1:], ends[1:]
    while len(pos):
        after = np.searchsorted(key, key[pos] + rules.length, "right")
        alive = after < stop
        pos, stop = after[alive], stop[alive]
        mark[pos] = True
    return mark


class Walk:
    """Cuts a stream of ordered clicks into sessions, batch by batch, given what is known before the first."""

    def __init__(self, part: int, rules: Rules, before: Known | None = None):
        self.part, self.rules, self.before, self.seq = part, rules, before, 0
        self.open: dict | None = None if before is None else self._opened(before.client, before.session, before.start, False)

    @staticmethod
    def _opened(client: int, session: int, start: int, whole: bool) -> dict:
        return {"client_id": client, "session_id": session, "start_us": start, "end_us": start, "n_clicks": 0, "n_late": 0, "value_cents": 0, "final": None, "ids": [], "whole": whole}

    def put_down(self, reason: str | None, over: bool) -> dict | None:
        """The open session as a finished row, or what is new of it as a piece. over: it ends, for the reason, if any, that the next click gives."""
        s = self.open
        if s is None:
            return None
        row = {k: v for k, v in s.items() if k not in ("ids", "whole")} | {"part": self.part, "reason": reason}
        path = ",".join(s["ids"])
        if s["whole"] and over:
            return row | {"kind": DONE, "seq": 0, "reason": reason or ("end" if s["final"] else "none"), "digest": hashlib.sha256(path.encode()).digest()}
        self.seq += 1
        s |= {"n_clicks": 0, "n_late": 0, "value_cents": 0, "ids": [], "whole": False}
        return row | {"kind": PIECE, "seq": self.seq, "path": path}

    def feed(self, c: np.ndarray) -> Iterator[dict]:
        timely = np.flatnonzero(~c["late"])
        t = c[timely]
        hard = certain_breaks(t, self.before, self.rules)
        mark = session_starts(t["us"], hard, self.before.start if self.before else None, self.rules)
        begin = np.flatnonzero(mark)
        bounds = np.r_[0, begin, len(t)]
        # late clicks count where the last timely click before them is, if that is the same client's
        late = np.flatnonzero(c["late"])
        at = np.searchsorted(timely, late) - 1
        own = np.where(at >= 0, t["client"][np.maximum(at, 0)] if len(t) else 0, self.before.client if self.before else 0)
        at_segment = np.where(at >= 0, np.cumsum(mark)[np.maximum(at, 0)] if len(t) else 0, 0)
        counted = (own == c["client"][late]) & ((at >= 0) | (self.before is not None))
        n_late = np.bincount(at_segment[counted], minlength=len(begin) + 1).tolist()
        cents = np.r_[0, np.cumsum(t["cents"])]
        cents = (cents[bounds[1:]] - cents[bounds[:-1]]).tolist()
        ids = list(map(str, t["id"].tolist()))
        bounds = bounds.tolist()
        last = t[np.maximum(np.array(bounds[1:]) - 1, 0)] if len(t) else t
        end_us, final = last["us"].tolist(), last["final"].tolist()
        before = begin - 1
        gap = np.zeros(len(begin), dtype=bool)
        same = np.zeros(len(begin), dtype=bool)
        ended = np.zeros(len(begin), dtype=bool)
        if len(begin):
            inner = before >= 0
            same[inner] = t["client"][begin[inner]] == t["client"][before[inner]]
            gap[inner] = t["us"][begin[inner]] - t["us"][before[inner]] >= self.rules.gap
            ended[inner] = t["final"][before[inner]]
            if not inner[0] and self.before is not None:
                same[0], gap[0], ended[0] = t["client"][0] == self.before.client, t["us"][0] - self.before.us >= self.rules.gap, self.before.final
        reasons = np.where(~same, None, np.where(ended, "end", np.where(gap, "gap", "length"))).tolist()
        heads = t[begin]
        clients, sessions, starts = heads["client"].tolist(), heads["id"].tolist(), heads["us"].tolist()
        for k in range(len(begin) + 1):
            if k:
                if row := self.put_down(reasons[k - 1], True):
                    yield row
                self.open = self._opened(clients[k - 1], sessions[k - 1], starts[k - 1], True)
            lo, hi = bounds[k], bounds[k + 1]
            if (s := self.open) is not None:
                s["n_late"] += n_late[k]
                if hi > lo:
                    s["n_clicks"] += hi - lo
                    s["value_cents"] += cents[k]
                    s["end_us"], s["final"] = end_us[k], final[k]
                    s["ids"] += ids[lo:hi]
                if len(s["ids"]) >= PIECE_IDS:
                    yield self.put_down(None, False)
        if len(t):
            self.before = Known(int(t["client"][-1]), int(t["us"][-1]), bool(t["final"][-1]), self.open["start_us"], self.open["session_id"])


def clicks_of(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, dtype=CLICK)
    for k, name in enumerate(("client", "us", "late", "id", "final", "cents")):
        col = batch.column(k)
        out[name] = (col.cast(pa.int64()) if name == "us" else col).to_numpy(zero_copy_only=False)
    return out


def cut(near: DataFrame, rules: Rules) -> DataFrame:
    """Of ordered clicks, task by task: finished sessions, pieces of the open ones, clicks put aside, and a row on the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        walk: Walk | None = None
        seq, first, last, lead_reason = 0, None, None, None
        for b in batches:
            c, out = clicks_of(b), []
            if walk is None:  # up to the first certain break after the first timely click
                timely = np.flatnonzero(~c["late"])
                t = c[timely]
                hard = certain_breaks(t, last, rules)
                if last is None and len(t):
                    hard[0], first = False, t[0]
                    last = Known(int(first["client"]), int(first["us"]), False, int(first["us"]), int(first["id"]))
                at = np.flatnonzero(hard)[:1]
                stop = int(timely[at[0]]) if len(at) else len(c)
                seq += 1
                out.append({"kind": LEAD, "part": part, "seq": seq, "rows": c[:stop].tobytes()})
                own = t[: at[0]] if len(at) else t
                if len(own):
                    begin = np.flatnonzero(session_starts(own["us"], np.zeros(len(own), dtype=bool), last.start, rules))
                    head = (int(own["us"][begin[-1]]), int(own["id"][begin[-1]])) if len(begin) else (last.start, last.session)
                    last = Known(int(own["client"][-1]), int(own["us"][-1]), bool(own["final"][-1]), *head)
                if len(at):
                    if t["client"][at[0]] == last.client:
                        lead_reason = "end" if last.final else "gap"
                    walk = Walk(part, rules)
                    out += walk.feed(c[stop:])
            else:
                out += walk.feed(c)
            if out:
                yield batch_of(out)
        end = walk.before if walk else last
        if end is not None:  # value_cents says whether the task holds a certain break; first click in end_us, path
            rows = [walk.put_down(None, False)] if walk else []
            told = {"kind": TASK, "part": part, "seq": 0, "client_id": end.client, "end_us": end.us, "final": end.final, "start_us": end.start, "session_id": end.session}
            yield batch_of([*rows, told | {"n_clicks": int(first["client"]), "n_late": int(first["us"]), "value_cents": int(walk is not None), "reason": lead_reason}])

    return near.mapInArrow(run, ROW)


# ------------------------------------------------------------------------------------- islands that span whole tasks

TABLE = "run int, at int, entry long, leave long, session long"


def entry_tables(lead: DataFrame, place: dict[int, tuple[int, int]], rules: Rules) -> DataFrame:
    """For each task that one island spans: from the time of the first click that may start a session there (entry) to the last session.

    All entries walk in step. A table has at most a row a click of the task.
    """

    def table(part: int, clicks: np.ndarray) -> pa.RecordBatch:
        us, ids = clicks["us"], clicks["id"]
        most = int(np.searchsorted(us, us[0] + rules.length, "right"))
        entry = np.flatnonzero(np.diff(us[: most + 1], prepend=us[0] - 1))
        pos = entry.copy()
        alive = np.arange(len(pos))
        while len(alive):
            after = np.searchsorted(us, us[pos[alive]] + rules.length, "right")
            go = after < len(us)
            alive = alive[go]
            pos[alive] = after[go]
        run, at = place[part]
        n = len(entry)
        return pa.RecordBatch.from_arrays([pa.array([run] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array(us[entry]), pa.array(us[pos]), pa.array(ids[pos])], ["run", "at", "entry", "leave", "session"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, []
        for b in batches:
            for p, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and own:
                    yield table(part, np.concatenate(own))
                    own = []
                c = np.frombuffer(rows, CLICK)
                part = p
                own.append(c[~c["late"]])
        if own:
            yield table(part, np.concatenate(own))

    of_runs = lead.where(F.col("part").isin(list(place))).repartition(max(1, len(place)), "part").sortWithinPartitions("part", "seq")
    return of_runs.select("part", "rows").mapInArrow(run, TABLE)


def composed(table: DataFrame, rules: Rules) -> DataFrame:
    """Tables of neighbours at 2k and 2k + 1 as one at k; the second may be absent."""

    def both(t: pa.Table) -> pa.Table:
        at, entry, leave, session = (t.column(n).to_numpy() for n in ("at", "entry", "leave", "session"))
        one, two = np.flatnonzero(at % 2 == 0), np.flatnonzero(at % 2)
        two = two[np.argsort(entry[two])]
        to = np.searchsorted(entry[two], leave[one] + rules.length, "right")
        on = to < len(two)
        one_leave, one_session = leave[one], session[one]
        one_leave[on], one_session[on] = leave[two][to[on]], session[two][to[on]]
        # what no click of the first task starts anew passes on to the second
        late = two[entry[two] > (entry[one].max() if len(one) else np.iinfo(np.int64).min)]
        e, v, s = np.r_[entry[one], entry[late]], np.r_[one_leave, leave[late]], np.r_[one_session, session[late]]
        return pa.table([pa.array([t.column("run")[0].as_py()] * len(e), pa.int32()), pa.array([int(at[0]) // 2] * len(e), pa.int32()), pa.array(e), pa.array(v), pa.array(s)], names=["run", "at", "entry", "leave", "session"])

    return table.groupBy("run", F.floor(F.col("at") / 2).cast("int").alias("pair")).applyInArrow(both, TABLE)


def resolved(lead: DataFrame, runs: list[list[int]], first: list[Known], rules: Rules) -> list[list[tuple[int, int]]]:
    """For runs of tasks that one island spans: (start, session) that reaches into each task and, last, out of the run.

    first: what is known before each run. The driver holds one pair a task.
    """
    place = {p: (r, k) for r, parts in enumerate(runs) for k, p in enumerate(parts)}
    levels = [stage_table(entry_tables(lead, place, rules), "entries")]
    depth = max(map(len, runs)).bit_length()
    while len(levels) < depth:
        levels.append(stage_table(composed(levels[-1], rules), "entries"))
    known = {(r, 0): (k.start, k.session) for r, k in enumerate(first)}
    for level in reversed(range(depth)):
        known = {(r, 2 * k): v for (r, k), v in known.items()}
        ask = [(r, k, v[0] + rules.length) for (r, k), v in known.items() if (k + 1) << level <= len(runs[r])]
        if not ask:
            continue
        wanted = lead.sparkSession.createDataFrame(ask, "run int, at int, least long")
        found = levels[level].join(F.broadcast(wanted), ["run", "at"]).where("entry > least").groupBy("run", "at").agg(F.min(F.struct("entry", "leave", "session")).alias("to"))
        to = {(x["run"], x["at"]): (x["to"]["leave"], x["to"]["session"]) for x in found.collect()}
        known |= {(r, k + 1): to.get((r, k), known[r, k]) for r, k, _ in ask}
    return [[known[r, k] for k in range(len(parts) + 1)] for r, parts in enumerate(runs)]


def reaching_in(tasks: list, lead: DataFrame, rules: Rules) -> dict[int, Known | None]:
    """What is known before each task by its number, and before AFTER_ALL; tasks: the rows that cut gives on them."""
    before: dict[int, Known | None] = {}
    runs: list[list[int]] = []
    follower: list[int] = []
    carry, in_run = None, False
    for r in [*sorted(tasks, key=lambda r: r["part"]), None]:
        part = r["part"] if r else AFTER_ALL
        before[part] = carry
        spans = r and carry is not None and not r["value_cents"] and carry.client == r["n_clicks"] and not carry.final and r["n_late"] - carry.us < rules.gap
        if spans:
            if not in_run:
                runs.append([])
            runs[-1].append(part)
        elif in_run:
            follower.append(part)
        in_run = bool(spans)
        carry = Known(r["client_id"], r["end_us"], r["final"], r["start_us"], r["session_id"]) if r else None
    if runs:
        with scratch(lead.sparkSession):
            for parts, after, found in zip(runs, follower, resolved(lead, runs, [before[x[0]] for x in runs], rules), strict=True):
                for p, (start, session) in zip([*parts, after], found, strict=True):
                    before[p] = replace(before[p], start=start, session=session)
    return before


# ------------------------------------------------------------------------------------------------------- the pieces


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """One finished row a session from its pieces, in order of task; a path of any length is hashed as it streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, some, out = None, None, False, []

        def done() -> dict:
            reason = now["reason"] or ("end" if now["final"] else "none")
            return now | {"kind": DONE, "reason": reason, "path": None, "digest": sha.digest()}

        for b in batches:
            for r in b.to_pylist():
                if now is None or (now["client_id"], now["session_id"]) != (r["client_id"], r["session_id"]):
                    if now is not None:
                        out.append(done())
                    now, sha, some = r, hashlib.sha256(), False
                else:
                    for k in ("n_clicks", "n_late", "value_cents"):
                        now[k] += r[k]
                    now["end_us"] = max(now["end_us"], r["end_us"])
                    now["reason"] = now["reason"] or r["reason"]
                    now["final"] = r["final"] if r["n_clicks"] else now["final"]
                if r["path"]:
                    sha.update((("," if some else "") + r["path"]).encode())
                    some = True
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([done()])

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "client_id", "session_id").sortWithinPartitions("client_id", "session_id", "part", "seq").mapInArrow(run, ROW)


def walked_leads(lead: DataFrame, before: dict[int, Known | None], ends: dict[int, tuple[bool, str | None]], rules: Rules) -> DataFrame:
    """Sessions and pieces of the clicks put aside. ends: whether a certain break follows them in their task, and its reason."""
    numbers = sorted(before)

    def known(part: int) -> Known | None:
        """A task of late clicks only knows what the next one does."""
        return before[numbers[int(np.searchsorted(numbers, part))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, walk = None, None

        def last() -> list[dict]:
            over, reason = ends.get(part, (False, None))
            row = walk.put_down(reason, over)
            return [row] if row else []

        for b in batches:
            out = []
            for p, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part:
                    if walk is not None:
                        out += last()
                    part, walk = p, Walk(p, rules, known(p))
                out += walk.feed(np.frombuffer(rows, CLICK))
            if out:
                yield batch_of(out)
        if walk is not None and (out := last()):
            yield batch_of(out)

    parts = int(lead.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lead.repartition(parts, "part").sortWithinPartitions("part", "seq").select("part", "rows").mapInArrow(run, ROW)


def sessions(clicks: DataFrame, rules: Rules = Rules(), final: Column | None = None) -> DataFrame:
    """One row a session: client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256.

    clicks: click_id, ts, arrived_at, client_id, kind, value, and any others. final says which clicks end their session
    (default: a purchase of 60 or more). Rows without click_id, client_id or ts are left out; of rows that repeat a
    click_id the least by (ts, client, late, final, value) counts. A null arrived_at is not late, a null value is 0 and not
    final. Ties in time go by click_id. Late clicks before a client's first session count nowhere. An empty table gives no rows.
    No client's clicks, nor any session's, need to fit into one task; the driver gets one short row a task.
    """
    spark = clicks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = pick(clicks, "click_id", "ts", "arrived_at", "client_id", "kind", "value")
    final = F.coalesce((F.col("kind") == "purchase") & (F.col("value") >= 60) if final is None else final, F.lit(False))
    late = F.coalesce(F.col("arrived_at") > F.col("ts") + F.expr(f"INTERVAL '{rules.late_minutes}' MINUTE"), F.lit(False))
    src = src.where("click_id is not null and client_id is not null and ts is not null").select(
        F.col("click_id").cast("long"), F.struct("ts", F.col("client_id").cast("long").alias("client"), late.alias("late"), final.alias("final"), F.coalesce(F.floor(F.col("value") * 100 + 0.5), F.lit(0)).cast("long").alias("cents")).alias("x")
    )
    once = src.groupBy("click_id").agg(F.min("x").alias("x")).select("x.client", "x.ts", "x.late", F.col("click_id").alias("id"), "x.final", "x.cents")
    order = ["client", "ts", "late", "id"]
    near = once.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    path = stage_path(spark, "sessions")
    with scratch(spark):
        stage = stage_table(cut(near, rules), "cut")
        tasks = stage.where(F.col("kind") == TASK).drop("path", "digest", "rows").collect()  # one short row a task
        lead = stage.where(F.col("kind") == LEAD).select("part", "seq", "rows")
        before = reaching_in(tasks, lead, rules)
        ends = {r["part"]: (bool(r["value_cents"]), r["reason"]) for r in tasks}
        walked = stage_table(walked_leads(lead, before, ends, rules), "walked")
        both = stage.where(F.col("kind").isin(DONE, PIECE)).unionByName(walked)
        out = both.where(F.col("kind") == DONE).unionByName(joined_pieces(both.where(F.col("kind") == PIECE)))
        out = out.select("client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", F.col("reason").alias("closed_by"), F.lower(F.hex("digest")).alias("path_sha256"))
        write_stage(out, path)
    return spark.read.schema(out.schema).parquet(path)


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


ORACLE = """
WITH RECURSIVE once AS (
  SELECT click_id, x.us AS us, x.client AS client_id, x.late AS late, x.final AS final, x.cents AS cents FROM (
    SELECT click_id, min(struct_pack(us := epoch_us(ts), client := client_id, late := coalesce(arrived_at > ts + INTERVAL 60 MINUTE, false),
      final := coalesce(kind = 'purchase' AND value >= 60, false), cents := CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT))) AS x
    FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL GROUP BY click_id)
), timely AS (
  SELECT *, coalesce(lag(final) OVER w OR us - lag(us) OVER w >= 300000000, true) AS hard FROM once WHERE NOT late
  WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)
), placed AS (
  SELECT *, sum(CASE WHEN hard THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY us, click_id) AS island FROM timely
), chain AS (
  SELECT client_id, island, min(us) AS us FROM placed GROUP BY client_id, island
  UNION ALL
  SELECT c.client_id, c.island, min(p.us) FROM chain c JOIN placed p ON p.client_id = c.client_id AND p.island = c.island AND p.us > c.us + 7200000000 GROUP BY c.client_id, c.island
), heads AS (
  SELECT c.client_id, min(p.click_id) AS session_id FROM chain c JOIN placed p USING (client_id, island, us) GROUP BY c.client_id, c.island, c.us
), numbered AS (
  SELECT p.*, sum(CASE WHEN h.session_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.client_id ORDER BY us, click_id) AS k
  FROM placed p LEFT JOIN heads h ON h.client_id = p.client_id AND h.session_id = p.click_id
), grouped AS (
  SELECT client_id, k, arg_min(click_id, (us, click_id)) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
    arg_max(final, (us, click_id)) AS final, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY us, click_id)) AS path_sha256
  FROM numbered GROUP BY client_id, k
), ranged AS (
  SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY k) AS next_us FROM grouped
), late AS (
  SELECT r.client_id, r.k, count(*) AS n FROM ranged r JOIN once o ON o.late AND o.client_id = r.client_id AND o.us >= r.start_us AND (r.next_us IS NULL OR o.us < r.next_us) GROUP BY r.client_id, r.k
)
SELECT r.client_id, session_id, start_us, end_us, n_clicks, coalesce(n, 0) AS n_late, value_cents,
  CASE WHEN final THEN 'end' WHEN next_us IS NULL THEN 'none' WHEN next_us - end_us >= 300000000 THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
FROM ranged r LEFT JOIN late l ON l.client_id = r.client_id AND l.k = r.k
"""
