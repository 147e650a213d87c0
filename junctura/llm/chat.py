r"""Chat formatting into budgeted windows.

Prefix sums over the token counts of a conversation's formatted turns (by the ``tokenizers`` library, each turn counted alone) choose spans of whole turns that fit a budget. Each window begins with the system turn, then
repeats a limited part of the turns before (history), then holds as many new turns as there is room for. Only assistant turns that are new in a
window are under its loss mask; repeated ones are masked out, so each is learned once.

Template, one turn: ``<s>[INST] text [/INST]`` for a user, ``[ASSISTANT] text </s>`` for an assistant, ``<<SYS>> text <</SYS>>`` for
the system, ``[ROLE name] text [/ROLE]`` for any other role (null: empty name). Inside texts and names a backslash becomes ``\\``
and ``<`` and ``[`` become ``\(`` and ``\{`` (in names ``]`` becomes ``\}``), so no control string can stand in a text and all of it can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import storage
from . import tokens as tokenized

BEFORE = {"user": "<s>[INST] ", "assistant": "[ASSISTANT] ", "system": "<<SYS>> "}
AFTER = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
BUDGET, HISTORY = 2048, 384
#: Budgets of tokens in a block of a long conversation, two at least; windows do not depend on it.
RUN = 32
_TURN = re.compile(r"(?s)<s>\[INST\] (?P<user>[^<\[]*) \[/INST\]|\[ASSISTANT\] (?P<assistant>[^<\[]*) </s>|<<SYS>> (?P<system>[^<\[]*) <</SYS>>|\[ROLE (?P<name>[^<\[\]]*)\] (?P<other>[^<\[]*) \[/ROLE\]")
_BACK = {"\\": "\\", "(": "<", "{": "[", "}": "]"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\(").replace("[", "\\{")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\({}])", lambda m: _BACK[m[1]], text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of the escaped text in it."""
    before = BEFORE.get(role) or "[ROLE " + escape(role).replace("]", "\\}") + "] "
    inner = escape(text)
    return before + inner + AFTER.get(role, " [/ROLE]"), len(before), len(before) + len(inner)


def turns_of(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text and the span of the escaped text of each turn of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        role = m.lastgroup if m.lastgroup != "other" else unescape(m["name"])
        a, b = m.span(m.lastgroup)
        out.append((role, unescape(formatted[a:b]), a, b))
        at = m.end()
    return out


def _counted(turns: DataFrame, budget: int, tokenizer: str) -> DataFrame:
    """c, place (from 0), role, text, tokens, run, early: turns with their place in the conversation, the run of RUN budgets that their first token is in, and whether it is in its first budget.

    Rows are range-dealt by conversation and turn; sums run inside a part of a conversation, and a part's base is the sum
    of the parts before it, one row each. So a conversation of any length is spread over tasks.
    """

    def count(roles: pd.Series, texts: pd.Series) -> pd.Series:
        encoder = tokenized.encoder(tokenizer)
        return pd.Series([len(x) for x in encoder.encode(turn(r, t)[0] for r, t in zip(roles, texts))], dtype="i8")

    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), of("role"), of("text"))
    rows = rows.withColumn("tokens", F.pandas_udf(count, "long")("role", "text"))
    dealt = rows.repartitionByRange(storage.shuffle_partitions(turns.sparkSession), F.col("c").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id())
    dealt = storage.stored(dealt, "turns")
    sums = dealt.groupBy("c", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("c").alias("base_c"), F.col("part").alias("base_part"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"base_{x}") for x in "nt"))
    here = Window.partitionBy("c", "part").orderBy(*order)
    before = F.coalesce(F.sum("tokens").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base_t")
    joined = dealt.join(base, F.col("c").eqNullSafe(F.col("base_c")) & (F.col("part") == F.col("base_part")))
    return joined.select("c", "role", "text", "tokens", (F.row_number().over(here) - 1 + F.col("base_n")).alias("place"), F.floor(before / (RUN * budget)).alias("run"), (before % (RUN * budget) < budget).alias("early"))


def _step(every: list[int], a: int, head: int, budget: int, history: int) -> tuple[int, int]:
    """First repeated turn and end of the window whose first new turn is a: history takes what its limit and that turn leave, new turns what is left then."""
    room = budget - head - every[a]
    back, left = a, min(history, room)
    while back > 0 and every[back - 1] <= left:
        back -= 1
        left -= every[back]
        room -= every[back]
    b = a + 1
    while b < len(every) and every[b] <= room:
        room -= every[b]
        b += 1
    return back, b


def spans(tokens: list[int], earlier: list[int], head: int, budget: int, history: int, after: int = -1, ahead: list[int] = (), start: int = 0) -> list[tuple[int, int, int]]:
    """First and end of the new turns of each window, and the number of turns repeated in front of them.

    tokens: of the turns of a block; earlier, ahead: of those before and behind it; head: of the system turn, which stands in front of windows that begin after turn ``after``; start: the
    block's first turn that is new in it. The last window may end among those ahead.
    """
    every, n = [*earlier, *tokens, *ahead], len(earlier)
    out, a = [], n + start
    while a < n + len(tokens):
        back, b = _step(every, a, head * (a - n > after), budget, history)
        out.append((a - n, b - n, a - back))
        a = b
    return out


def exits(tokens: list[int], earlier: list[int], head: int, budget: int, history: int, after: int, ahead: list[int], starts: list[int]) -> list[int]:
    """For each turn that a block could start with, the first new turn behind the block."""
    every, n, known = [*earlier, *tokens, *ahead], len(earlier), {}
    for start in starts:
        a, path = n + start, []
        while a < n + len(tokens) and a not in known:
            path.append(a)
            a = _step(every, a, head * (a - n > after), budget, history)[1]
        known |= dict.fromkeys(path, known.get(a, a))
    return [known[n + x] - n for x in starts]


def _entries(blocks: DataFrame, starts: DataFrame, budget: int, history: int) -> DataFrame | None:
    """c, run, entry: the place at which each block's first window begins; None if no conversation has two blocks.

    A block is a function from the turns it may begin with to the turn that the next one begins with. Following these from turn 0 takes as
    many joins as the number of blocks has bits: steps double, and so do the blocks that are reached.
    """
    ends = blocks.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("c").alias("many"))
    if not ends.limit(1).count():
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, number, first, new, earlier, ahead, head, system, begin in zip(b["c"].astype(object), b["run"], b["first"], b["new"], b["earlier"], b["ahead"], b["head"], b["system"], b["begin"]):
                begin = sorted(begin)
                found = exits(list(new), list(earlier), int(head), budget, history, int(system - first), list(ahead), [x - first for x in begin])
                out += [(None if pd.isna(conv) else int(conv), number, x, first + z) for x, z in zip(begin, found)]
            yield pd.DataFrame(out, columns=["c", "run", "a", "z"]).astype({"c": "Int64"})

    tokens = lambda c: F.coalesce(F.transform(c, lambda x: x["tokens"]), F.array().cast("array<long>"))
    none = F.array().cast("array<long>")
    known = starts.select(F.col("c").alias("start_c"), F.col("run").alias("start_run"), F.transform("ahead", lambda x: x["place"]).alias("begin"))
    rows = blocks.join(ends, F.col("c").eqNullSafe(F.col("many"))).join(known, F.col("c").eqNullSafe(F.col("start_c")) & (F.col("run") == F.col("start_run")), "left")
    rows = rows.select("c", "run", "first", tokens("turns").alias("new"), tokens("history").alias("earlier"), tokens("ahead").alias("ahead"), F.coalesce("system.tokens", F.lit(0)).alias("head"), F.coalesce("system.place", F.lit(-1)).alias("system"), F.array_union(F.coalesce("begin", none), F.array("first")).alias("begin"))
    edges = storage.stored(rows.mapInPandas(run, "c long, run long, a long, z long"), "exits")
    jump, reached = edges.select("c", "a", "z"), edges.filter("a = 0").select("c", "a")
    pair = F.col("c").eqNullSafe(F.col("of"))
    while True:
        new = storage.stored(reached.join(jump.withColumnRenamed("c", "of").withColumnRenamed("a", "at"), pair & (F.col("a") == F.col("at"))).select("c", F.col("z").alias("a")), "reached")
        if not new.limit(1).count():
            break
        reached = reached.unionByName(new)
        further = jump.select(F.col("c").alias("of"), F.col("a").alias("at"), F.col("z").alias("to"))
        jump = storage.stored(jump.join(further, pair & (F.col("z") == F.col("at"))).select("c", "a", F.col("to").alias("z")), "jumps")
    at = reached.select(F.col("c").alias("of"), F.col("a").alias("at"))
    return edges.join(at, pair & (F.col("a") == F.col("at"))).select(F.col("c").alias("entry_c"), F.col("run").alias("entry_run"), F.col("a").alias("entry"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Format conversations (conv_id, turn, role, text; other columns are ignored) into windows.

    Turns are taken in (turn, role, text) order. Columns: conv_id, first (place of the first new turn), n_repeated (turns in front of the
    new ones: the first system turn and what is repeated before), n_tokens (sum of the turns' counts), text, loss (array of start and end in
    code points, the escaped texts of new assistant turns). A window keeps to ``budget`` tokens and its history to ``history``, unless the system turn and
    one new turn are longer than that by themselves; such a turn stands alone behind the system turn. Windows of a conversation of any length are those that one pass from its first turn would make. Null texts and
    roles count as empty, null conv_ids as one conversation; rows that repeat are turns of their own; an empty table gives none.
    """
    placed = storage.stored(_counted(turns, budget, tokenizer or tokenized.default_tokenizer()), "places")
    fields = F.struct("place", "role", "text", "tokens")
    runs = placed.groupBy("c", "run").agg(F.sort_array(F.collect_list(fields)).alias("turns")).select("c", "run", "turns", F.get("turns", F.lit(0))["place"].alias("first"), F.element_at("turns", -1)["place"].alias("last"))
    runs = storage.stored(runs, "runs")
    # of the run before, the last turns that history has room for: each has a token at least; of the run behind, what starts within a budget, so that a window of this one may hold it
    before = runs.select(F.col("c").alias("before_c"), (F.col("last") + 1).alias("next"), F.slice("turns", F.greatest(F.size("turns") - (history - 1), F.lit(1)), history).alias("history"))
    starts = placed.filter("early").groupBy("c", "run").agg(F.sort_array(F.collect_list(fields)).alias("ahead"))
    behind = starts.filter("run > 0").select(F.col("c").alias("behind_c"), F.get("ahead", F.lit(0))["place"].alias("begins"), "ahead")
    system = placed.filter("role = 'system'").groupBy("c").agg(F.min(F.struct("place", "text", "tokens")).alias("system")).withColumnRenamed("c", "system_c")
    joined = runs.join(before, F.col("c").eqNullSafe(F.col("before_c")) & (F.col("first") == F.col("next")), "left")
    joined = joined.join(behind, F.col("c").eqNullSafe(F.col("behind_c")) & (F.col("last") + 1 == F.col("begins")), "left").join(system, F.col("c").eqNullSafe(F.col("system_c")), "left")
    entries = _entries(joined, starts, budget, history)
    if entries is None:
        joined = joined.withColumn("entry", F.col("first"))
    else:
        joined = joined.join(entries, F.col("c").eqNullSafe(F.col("entry_c")) & (F.col("run") == F.col("entry_run")), "left").withColumn("entry", F.when(F.col("first") == 0, F.lit(0).cast("long")).otherwise(F.col("entry"))).filter("entry is not null")  # the turns of a last block may all be in a window that begins before it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, new, earlier, ahead, system, entry in zip(b["c"].astype(object), b["turns"], b["history"], b["ahead"], b["system"], b["entry"]):
                earlier, new, ahead = [] if earlier is None else list(earlier), list(new), [] if ahead is None else list(ahead)
                every = [*earlier, *new, *ahead]
                head, after = (0, 0) if system is None else (system["tokens"], system["place"] - new[0]["place"])
                for a, e, back in spans([t["tokens"] for t in new], [t["tokens"] for t in earlier], head, budget, history, after, [t["tokens"] for t in ahead], int(entry) - new[0]["place"]):
                    taken = every[len(earlier) + a - back : len(earlier) + e]
                    first = new[a]["place"]
                    top = [] if system is None or system["place"] >= first or any(t["place"] == system["place"] for t in taken) else [dict(system) | {"role": "system"}]
                    parts, loss, at = [], [], 0
                    for k, t in enumerate([*top, *taken]):
                        text, x, y = turn(t["role"], t["text"])
                        if k >= len(top) + back and t["role"] == "assistant":
                            loss.append({"start": at + x, "end": at + y})
                        parts.append(text)
                        at += len(text)
                    out.append((None if pd.isna(conv) else int(conv), first, len(top) + back, sum(t["tokens"] for t in [*top, *taken]), "".join(parts), loss))
            yield pd.DataFrame(out, columns=["conv_id", "first", "n_repeated", "n_tokens", "text", "loss"]).astype({"conv_id": "Int64"})

    return joined.select("c", "turns", "history", "ahead", "system", "entry").mapInPandas(run, "conv_id long, first long, n_repeated int, n_tokens long, text string, loss array<struct<start:int,end:int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read windows back: per conversation n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A hash needs its conversation in order, so windows are dealt by conversation and sorted; a task streams them and
    holds no more than a batch, but one conversation is one task's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for b in batches:
            for conv, repeated, text, loss in zip(b["conv_id"].astype(object), b["n_repeated"], b["text"], b["loss"]):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now[0] != conv:
                    out += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, t, _, _ in turns_of(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{t}\n".encode(errors="surrogatepass"))
                for span in loss:
                    t = unescape(text[span["start"] : span["end"]])
                    now[3] += len(t)
                    now[4].update(t.encode(errors="surrogatepass"))
                now[5] += len(text)
            yield _digest_rows(out)
            out = []
        yield _digest_rows([now] if now else [])

    dealt = formatted.repartition(storage.shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "first")
    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(found: list[list]) -> pd.DataFrame:
    rows = [(c, n, turns.hexdigest(), chars, loss.hexdigest(), total) for c, n, turns, chars, loss, total in found]
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
