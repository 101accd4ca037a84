"""Repair of conversation structure by a fold over sorted turns.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Windows flag the faults of every row;
the rows are collected as sorted structs, and ``aggregate()`` carries four (cost, audit) structs, one
for each place in that pattern: nothing yet, after ``s``, after ``u``, after ``ua``.  Every step takes
native ``least`` of what can lead to a place, so equal costs are settled by the smaller audit.

A long conversation is folded in pieces of ``piece_turns`` consecutive turn numbers, each in a task of
its own: a piece is folded once from each place, and a second fold over the pieces joins the results,
four structs again.  Two audits of one piece that start and end at the same places with equal costs never
begin with one another, so the smaller one stays the smaller whatever follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What does not count as a character of a text.
_BLANKS = " \t\n\x0b\x0c\r"
#: Fixed costs of the edits; an undeleted truncated row adds ``_CUT``.
_DELETE, _REROLE, _INSERT, _CUT = 3, 2, 2, 1
#: A cost that no repair reaches.
_NEVER = 1 << 40
_PLACES = ("e", "s", "u", "a")
_STEP = "struct<cost:bigint,audit:string>"


def damaged_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, alive) after the damage that crc32 of ``id:turn`` modulo 20 names.

    0 drops the row (it comes back with ``alive`` false), 1 empties its text, 2 takes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it a user's.  Nulls count as one space, in the hash as in role
    and text; the returned conv and turn stay null.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(known(id_col), F.lit(":"), known(turn_col)).cast("binary")), F.lit(20))
    read = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return read.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("alive"), F.explode(times).alias("n")).drop("n")


def turn_faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``nth``, its place among those of equal role and text, and ``fault``: blank, duplicate (seen earlier), truncated (no full stop or the like at its end), or null."""
    seen = F.row_number().over(Window.partitionBy("conv", "alive", "role", "text").orderBy("turn"))
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(bare == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return turns.withColumn("nth", seen).withColumn("fault", F.when(F.col("alive"), fault))


def _never() -> Column:
    return F.struct(F.lit(_NEVER).alias("cost"), F.lit("").alias("audit"))


def _then(step: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((step["cost"] + cost).alias("cost"), F.concat(step["audit"], F.lit(letter)).alias("audit"))


def _places(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _inserted(at: Column) -> Column:
    """The four structs when turns may be inserted: two lead from anywhere to anywhere in ``ua``."""
    user = F.least(at["u"], *(_then(at[p], _INSERT, "I") for p in "esa"))
    assistant = F.least(at["a"], _then(at["u"], _INSERT, "I"), *(_then(at[p], 2 * _INSERT, "II") for p in "es"))
    return _places(at["e"], at["s"], user, assistant)


def _edited(at: Column, turn: Column) -> Column:
    """The four structs after one row: kept, given another role or deleted, after what was inserted before it."""
    stays = turn["fault"].isNull() | (turn["fault"] == "truncated")
    more = F.when(stays, F.when(turn["fault"].isNull(), 0).otherwise(_CUT)).otherwise(F.lit(_NEVER)).cast("long")
    as_is = lambda initial: turn["initial"] == initial

    def placed(before: Column, initial: str) -> Column:
        return F.when(as_is(initial), _then(before, more, "K")).otherwise(_then(before, more + _REROLE, "R"))

    kept_system = F.when(as_is("s"), _then(at["e"], more, "K")).otherwise(_never())
    deleted = {p: _then(at[p], _DELETE, "D") for p in _PLACES}
    # A user's turn follows nothing, a system's or an assistant's: where two are equal in cost, the audit decides.
    user = F.least(deleted["u"], *(placed(at[p], "u") for p in "esa"))
    return _places(deleted["e"], F.least(deleted["s"], kept_system), user, F.least(deleted["a"], placed(at["u"], "a")))


def _fold(turns: Column, start: str) -> Column:
    """Four structs after all of ``turns``, begun at one place."""
    origin = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    # The inner step is named so that what is inserted is computed once for each row.
    step = lambda at, turn: F.aggregate(F.array(turn), _inserted(at), _edited)
    return F.aggregate(turns, _places(*(origin if p == start else _never() for p in _PLACES)), step)


def _joined(at: Column, piece: Column) -> Column:
    """The four structs after one more piece; a bar ends each piece, at the same row in every audit."""
    ways = lambda to: [F.struct((at[p]["cost"] + piece[p][to]["cost"]).alias("cost"), F.concat(at[p]["audit"], piece[p][to]["audit"], F.lit("|")).alias("audit")) for p in _PLACES]
    return _places(*(F.least(*ways(to)) for to in _PLACES))


def _illegal(initials: Column) -> Column:
    """Neighbours in the array whose initials are not su, ua or au."""
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials)), lambda x, y: F.concat(x, y))
    return F.when(F.size(initials) < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).cast("long")


def folded_pieces(turns: DataFrame, piece_turns: int) -> DataFrame:
    """One row per conversation and piece: counts of its faults, its turns, and the four folds over it."""
    piece = F.floor(F.col("turn") / piece_turns)
    turn = F.struct("turn", "role", "text", "nth", F.substring("role", 1, 1).alias("initial"), "fault")
    grouped = turns.groupBy("conv", piece.alias("piece")).agg(F.array_sort(F.collect_list(F.when(F.col("alive"), turn))).alias("turns"))
    # Only the first piece begins with nothing before it, and it begins with nothing else.
    first = F.row_number().over(Window.partitionBy("conv").orderBy("piece")) == 1
    grouped = grouped.where(F.size("turns") > 0).withColumn("first", first)
    shut = _places(*[_never()] * 4)
    folds = [F.when(F.col("first") & F.lit(p != "e"), shut).otherwise(_fold(F.col("turns"), p)).alias(p) for p in _PLACES]
    count = lambda kind: F.size(F.filter("turns", lambda t: t["fault"] == kind)).cast("long").alias(kind)
    known = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    return grouped.select(
        "conv", "piece", "turns", F.transform("turns", lambda t: t["initial"]).alias("initials"), count("blank"), count("duplicate"), count("truncated"),
        F.array_min(known).alias("low"), F.array_max(known).alias("high"), F.size(F.array_distinct(known)).cast("long").alias("distinct"), F.struct(*folds).alias("fold"),
    )


def _replayed(pieces: Column, audit: Column, has_system: Column) -> Column:
    """``role:text`` of every turn that the audit leaves or inserts, in order."""
    size = lambda letters, without: F.length(F.translate(letters, without, ""))

    def piece(p: Column, at: Column) -> Column:
        own = F.get(F.split(audit, "[|]"), at)
        before = size(F.call_function("substring_index", audit, F.lit("|"), at), "D|")

        def edit(letter: Column, k: Column) -> Column:
            upto = F.substring(own, F.lit(1), k + 1)
            turn = F.get(p["turns"], size(upto, "I") - 1)
            nth = before + size(upto, "D") - 1 - has_system
            role = F.when(letter == "K", turn["role"]).when(F.pmod(nth, F.lit(2)) == 0, F.lit("user")).otherwise(F.lit("assistant"))
            return F.when(letter != "D", F.concat(role, F.lit(":"), F.when(letter == "I", F.lit("")).otherwise(turn["text"])))

        return F.filter(F.transform(F.regexp_extract_all(own, F.lit("(.)")), edit), lambda x: x.isNotNull())

    return F.flatten(F.transform(pieces, piece))


def repaired_conversations(turns: DataFrame, piece_turns: int = 512) -> DataFrame:
    """One row per conv: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of ``role:text``).

    ``turns`` has (conv, turn, role, text, alive, nth, fault); rows that are not alive only name their conversation.
    The order is by turn, nulls first, then role and text.  Edits are Keep (cost 0), Rerole to user or
    assistant (2), Delete (3; blank and duplicate rows have no other way) and Insert of an empty user's or
    assistant's turn (2); a truncated row that stays adds 1.  The audit has the initials of the cheapest edits
    in order, of equally cheap ones the smallest.  Null ids are one conversation; a role of no such initial, the
    empty one among them, can be given another or deleted.  A conversation without rows has zeros, an empty audit and nothing
    repaired.  An empty table gives an empty one.

    The turns of one conversation meet in one row at the end, as its repaired text does; the folds over them do not.
    """
    folded = folded_pieces(turns, piece_turns)
    every = F.array_sort(F.collect_list(F.struct("piece", *[c for c in folded.columns if c not in ("conv", "piece")]))).alias("pieces")
    met = folded.groupBy("conv").agg(
        every, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.max("high") - F.min("low") + 1 - F.sum("distinct")).alias("gaps")
    )
    begun = _places(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")), *[_never()] * 3)
    # What is inserted at the very end stands before the last bar.
    unbarred = lambda step: F.struct(step["cost"].alias("cost"), F.regexp_replace(step["audit"], "[|]$", "").alias("audit"))
    ends = F.aggregate("pieces", begun, lambda at, p: _joined(at, p["fold"]))
    ends = F.transform(F.array(ends), lambda x: _inserted(_places(*(unbarred(x[p]) for p in _PLACES))))[0]
    met = met.withColumn("ends", ends).withColumn("best", F.least("ends.e", "ends.a")).withColumn("initials", F.flatten("pieces.initials"))
    plain = F.replace(F.col("best.audit"), F.lit("|"), F.lit(""))
    kept_first = F.length(F.regexp_extract(plain, "^(D*)K", 1))
    has_system = (plain.rlike("^D*K") & (F.get("initials", kept_first) == "s")).cast("int")
    met = met.withColumn("has_system", has_system)
    fixed = met.select(
        F.col("conv").alias("of"), "gaps", "blank", "duplicate", "truncated", _illegal(F.col("initials")).alias("illegal"), F.col("best.cost").alias("cost"), plain.alias("audit"),
        _replayed(F.col("pieces"), F.col("best.audit"), F.col("has_system")).alias("repaired"),
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = turns.select("conv").distinct()
    return ids.join(fixed, F.col("conv").eqNullSafe(F.col("of")), "left").select(
        "conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired", F.array().cast("array<string>")).alias("repaired"),
    )


def damaged_and_repaired(rows: DataFrame, piece_turns: int = 512, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation of ``rows`` damaged and repaired: ``id_col``, the counts, cost, audit, ``repaired`` and its SHA-256.

    Other columns of ``rows`` are ignored; repeated rows are rows of their conversation.
    """
    out = repaired_conversations(turn_faults(damaged_turns(rows, id_col, turn_col, role_col, text_col)), piece_turns)
    digest = F.sha2(F.array_join("repaired", "\n").cast("binary"), 256)
    return out.withColumn("repaired_sha256", digest).withColumnRenamed("conv", id_col)
