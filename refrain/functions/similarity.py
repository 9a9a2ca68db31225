"""Similarity predicates, all as boolean Columns over keys or raw strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions.text import ascii_key, bind, combined_lookup, combined_lookup_of, js_trim, loosened, name_key, title_key


def within(a: Column, b: Column, limit: int) -> Column:
    """At most ``limit`` edits apart; the bounded distance gives up early."""
    return F.levenshtein(a, b, limit) >= 0


def tolerance(key: Column) -> Column:
    """How many edits a key of this length may stray."""
    return F.when(F.length(key) >= 12, 2).when(F.length(key) >= 7, 1).otherwise(0)


def transposed(a: Column, b: Column) -> Column:
    """Equal but for one swapped neighbouring pair."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(
            F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)),
            F.substring(a, i + 2, F.length(a)),
        ) == b,
    )
    return F.when((F.length(a) < 2) | (F.length(a) != F.length(b)) | (a == b), False).otherwise(swapped)


def near_by(candidate: Column, key: Column, slack: Column) -> Column:
    """Within ``slack`` (0 to 2) edits."""
    return (
        F.when(slack == 2, within(candidate, key, 2))
        .when(slack == 1, within(candidate, key, 1))
        .otherwise(candidate == key)
    )


def nearly_same(candidate: Column, key: Column) -> Column:
    """A plausible misspelling of ``key``; short keys allow one swapped pair and nothing else."""
    slack = tolerance(key)
    return F.when(slack == 0, transposed(candidate, key)).otherwise(near_by(candidate, key, slack))


def credit_parts(artist: Column, credit: Column, lead: Callable[[Column], Column]) -> dict[str, Column]:
    """Keys the credit predicates compare."""
    credit_lead = F.coalesce(lead(credit), js_trim(F.split(credit, ",", 2)[0]), credit)
    return {
        "own": combined_lookup(artist), "credit": combined_lookup(credit),
        "lead": combined_lookup_of(lead(artist)), "credit_lead": combined_lookup_of(credit_lead),
    }


def keys_close_enough(own: Column, credit: Column, lead: Column, credit_lead: Column) -> Column:
    """``artist_close_enough`` on ready keys; ``lead`` is null for a single artist."""
    shared_head = (
        (F.length(own) >= 5) & (F.length(credit) >= 5) & (F.startswith(own, credit) | F.startswith(credit, own))
    )
    by_lead = (lead != "") & (
        F.startswith(credit, lead)
        | nearly_same(credit, lead)
        | ((credit_lead != "") & ((lead == credit_lead) | nearly_same(lead, credit_lead)))
    )
    return (own != "") & (credit != "") & (
        (own == credit) | nearly_same(own, credit) | shared_head | F.coalesce(by_lead, F.lit(False))
    )


def keys_accept_title(own: Column, credit: Column, lead: Column, credit_lead: Column, title: Column) -> Column:
    """``accept_title_first`` on ready keys."""
    strict = (own == credit) | nearly_same(own, credit) | F.coalesce(
        (lead != "") & ((lead == credit_lead) | nearly_same(lead, credit_lead)), F.lit(False)
    )
    return keys_close_enough(own, credit, lead, credit_lead) & ((F.length(title) >= 8) | strict)


def artist_close_enough(artist: Column, credit: Column) -> Column:
    from refrain.functions.names import lead_artist

    parts = credit_parts(artist, credit, lead_artist)
    return keys_close_enough(parts["own"], parts["credit"], parts["lead"], parts["credit_lead"])


def accept_title_first(artist: Column, credit: Column, title: Column) -> Column:
    from refrain.functions.names import lead_artist

    parts = credit_parts(artist, credit, lead_artist)
    return keys_accept_title(parts["own"], parts["credit"], parts["lead"], parts["credit_lead"], title)


def _contained(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _shorter(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b))


def _long_enough(a: Column, b: Column) -> Column:
    floor = F.floor(F.greatest(F.length(a), F.length(b)) * 0.45)
    return _shorter(a, b) >= F.least(F.lit(8), F.greatest(F.lit(4), floor))


def _few_edits(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) <= F.greatest(F.lit(2), F.floor(_shorter(a, b) * 0.25))


def title_names_work(bare_recording: Column, work: Column) -> Column:
    """Whether a linked work's title names the same song as the (bracket-stripped) recording."""
    cut = js_trim(work).rlike(r"(?:\.\.\.|…)\z")
    return bind(
        F.struct(title_key(bare_recording).alias("a"), title_key(work).alias("b"), cut.alias("cut")),
        lambda k: F.when(k["cut"] | (k["a"] == "") | (k["b"] == ""), False)
        .when(k["a"] == k["b"], True)
        .when(_contained(k["a"], k["b"]), _long_enough(k["a"], k["b"]))
        .otherwise(_few_edits(k["a"], k["b"])),
    )


def titles_corroborate(left: Column, right: Column) -> Column:
    """Two titles another catalogue may give the same song."""
    return bind(
        F.struct(title_key(left).alias("a"), title_key(right).alias("b")),
        lambda k: bind(
            F.struct(k["a"].alias("a"), k["b"].alias("b"), loosened(k["a"]).alias("x"), loosened(k["b"]).alias("y")),
            lambda m: F.when((m["a"] == "") | (m["b"] == ""), False)
            .when(m["a"] == m["b"], True)
            .when(_contained(m["a"], m["b"]), _long_enough(m["a"], m["b"]))
            .when(m["x"] == m["y"], True)
            .when(_contained(m["x"], m["y"]), _shorter(m["x"], m["y"]) >= 8)
            .otherwise(_few_edits(m["x"], m["y"])),
        ),
    )


def names_agree(left: Column, right: Column) -> Column:
    a, b = title_key(left), title_key(right)
    return (a != "") & (b != "") & _contained(a, b)


def related_acts(left: Column, right: Column) -> Column:
    """One name begins with the other: a band and its front, not two strangers."""
    a, b = name_key(left), name_key(right)
    return F.coalesce((a != b) & (F.startswith(a, b) | F.startswith(b, a)), F.lit(False))


def is_loose_hit(asked: Column, got: Column) -> Column:
    a, b = ascii_key(asked), ascii_key(got)
    return (a != b) & ~F.startswith(b, a)


# Most edits any allowed pair with a key of length n can have.
_REACH = "CASE WHEN {n} >= 10 THEN 2 WHEN {n} >= 6 THEN 1 ELSE 0 END"
_SWAPS = "concat(n, ':swap:', array_join(array_sort(split({key}, '')), ''))"


def _piece(key: str, shift: str) -> str:
    """Piece i of s.r + 1 equal pieces of a key of length s.m, read from ``key`` with a shift."""
    start, end = "(s.m * i) div (s.r + 1)", "(s.m * (i + 1)) div (s.r + 1)"
    return f"concat(s.m, ':', i, ':', substring({key}, CAST({start} + 1 + {shift} AS INT), CAST({end} - {start} AS INT)))"


def _with_length(key: str, body: str) -> Column:
    return F.get(F.expr(f"transform(array(length({key})), n -> {body})"), F.lit(0))


def near_blocks(key: str) -> Column:
    """Blocking keys of the indexed side of a near join, for a column name.

    A key reached with at most k edits keeps one of k + 1 pieces unedited. Pieces are tagged
    with the key's length and their index; keys short enough for swaps only carry their
    sorted letters.
    """
    sized = f"array(named_struct('m', n, 'r', {_REACH.format(n='n')}))"
    pieces = f"flatten(transform({sized}, s -> transform(sequence(0, s.r), i -> {_piece(key, '0')})))"
    swaps = f"array({_SWAPS.format(key=key)})"
    return _with_length(key, f"CASE WHEN n < 6 THEN {swaps} WHEN n = 6 THEN concat({pieces}, {swaps}) ELSE {pieces} END")


def near_probes(key: str) -> Column:
    """Blocking keys of the probing side: every place an unedited piece can have moved to.

    With r allowed edits and a length difference of n - m, the first unedited piece i lies at
    most i places off from the left and at most r - i places off from the right.
    """
    sized = f"transform(filter(sequence(n - 2, n + 2), m -> m >= 6), m -> named_struct('m', m, 'r', {_REACH.format(n='m')}))"
    lengths = f"filter({sized}, s -> abs(s.m - n) <= s.r)"
    shifts = "sequence(greatest(-i, n - s.m - s.r + i), least(i, n - s.m + s.r - i))"
    moved = f"flatten(transform(sequence(0, s.r), i -> transform({shifts}, d -> {_piece(key, 'd')})))"
    every = f"flatten(transform({lengths}, s -> {moved}))"
    swaps = f"CASE WHEN n <= 6 THEN array({_SWAPS.format(key=key)}) ELSE array() END"
    return _with_length(key, f"array_distinct(concat({every}, {swaps}))")
