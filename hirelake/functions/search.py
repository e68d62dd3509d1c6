"""Weighted text search over a posting: terms, hits, rank.

Zones weigh title 1.0 (A), location and department 0.4 (B), description 0.2 (C). Positions run on
from zone to zone. The rank is r / (r + 1).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import first_of

# --- fixed values -----------------------------------------------------------------
ZONE_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
TERM_BREAK = r"[^\p{L}\p{N}+#.]+"

_START = r"(?:\A|[^\p{L}\p{N}+#.])[.+#]*"
_END = r"[.+#]*(?=\z|[^\p{L}\p{N}+#.])"


def query_terms(text: str, limit: int | None = None) -> list[str]:
    """Terms of one query string, all or the first `limit`."""
    raw = re.split(r"[^\w+#.]+|_", text.lower())
    return [t for t in (x.strip(".+#") for x in raw) if t][:limit]


def profile_terms(values: list[str], limit: int | None = None) -> list[str]:
    """Distinct terms of a keyword list, all or the first `limit`."""
    return list(dict.fromkeys(t for v in values for t in query_terms(v)))[:limit]


def terms_of(text: Column) -> Column:
    """Terms of a text column, in order."""
    parts = F.transform(F.split(F.lower(text), TERM_BREAK), lambda w: F.regexp_replace(w, r"\A[.+#]+|[.+#]+\z", ""))
    return F.coalesce(
        F.filter(parts, lambda w: F.length(w) > 0), F.array().cast("array<string>")
    )


def profile_terms_of(values: Column, limit: int | None = None) -> Column:
    """Column form of `profile_terms`."""
    terms = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), terms_of))
    return first_of(F.array_distinct(terms), limit)


def _any_of(terms: list[str]) -> str:
    return "(?:" + "|".join(re.escape(t).replace("/", r"\/") for t in sorted(terms, key=len, reverse=True)) + ")"


def prefix_pattern(terms: list[str]) -> str:
    """Matches at each token that starts with one of the terms."""
    return _START + _any_of(terms)


def word_pattern(term: str) -> str:
    """Matches each token that is the term."""
    return _START + re.escape(term) + _END


class SharedTexts:
    """Descriptions that many postings share: whatever is asked of them is worked out once per text, and only the answers
    are joined to the postings.

    `texts` holds a key and the description; postings carry the key instead of the description. All is asked before the
    one join. A key that several texts have gives a posting as many rows, as a join with the texts would.
    """

    def __init__(self, texts: DataFrame, key: str, description: str = "description"):
        self.texts, self.key, self.description = texts, key, description
        self._answers: dict[str, tuple[str, Column, Column]] = {}
        self._joined = False

    def ask(self, question: str, answer: Callable[[Column], Column]) -> Column:
        """`answer` of the description, null taken for empty; `question` names it, so that it is worked out once."""
        if question not in self._answers:
            if self._joined:
                raise ValueError(f"asked after the join: {question}")
            text = F.coalesce(F.col(self.description), F.lit(""))
            self._answers[question] = (f"_text{len(self._answers)}", answer(text), answer(F.lit("")))
        name, _, empty = self._answers[question]
        return F.coalesce(F.col(name), empty)

    def join(self, postings: DataFrame) -> DataFrame:
        """`postings` with the answers to all that was asked."""
        self._joined = True
        answers = self.texts.select(self.key, *[given.alias(name) for name, given, _ in self._answers.values()])
        return postings.join(answers, self.key, "left")

    def drop(self, postings: DataFrame) -> DataFrame:
        return postings.drop(self.key, *[name for name, _, _ in self._answers.values()])


class Zones:
    """The searchable columns of a posting, lower-cased once; the description's part may come from `SharedTexts`."""

    def __init__(
        self, title="title", location="location", department="department", description="description", texts: SharedTexts | None = None
    ):
        self.a = F.lower(F.coalesce(F.col(title), F.lit("")))
        self.b = F.lower(F.concat_ws(" ", F.col(location), F.col(department)))
        self.description, self.texts = description, texts

    def body_has(self, pattern: str) -> Column:
        if self.texts is not None:
            return self.texts.ask(f"has {pattern}", lambda text: F.lower(text).rlike(pattern))
        return F.lower(F.coalesce(F.col(self.description), F.lit(""))).rlike(pattern)

    def has(self, pattern: str) -> Column:
        return self.a.rlike(pattern) | self.b.rlike(pattern) | self.body_has(pattern)


def matches_all_prefixes(zones: Zones, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & zones.has(prefix_pattern([t]))
    return out


def matches_any_prefix(zones: Zones, terms: list[str]) -> Column:
    return zones.has(prefix_pattern(terms))


def matches_all_words(zones: Zones, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & zones.has(word_pattern(t))
    return out


def any_term_share(zones: Zones, terms: list[str]) -> Column:
    """Share of a text criterion an OR query earns: least(1, 4 · r/(r+1)).

    Every hit adds its zone weight to r, so one title or B hit, or two in C, already earn it all and
    a single C hit earns two thirds. Counting stops at two.
    """
    p = prefix_pattern(terms)
    twice = rf"(?s){p}.*?{p}"
    return (
        F.when(zones.a.rlike(p) | zones.b.rlike(p) | zones.body_has(twice), F.lit(1.0))
        .when(zones.body_has(p), F.lit(2.0 / 3.0))
        .otherwise(F.lit(0.0))
    )


def search_tokens(
    title="title", location="location", department="department", description: str | None = "description",
    texts: SharedTexts | None = None, starts: list[str] | None = None,
) -> Column:
    """array<struct<term, w, pos>> over all zones; with `starts` only the tokens that begin with one of them, where they stand.

    Without `description` the tokens of the description, which come last, are left to the caller.
    """

    def zone(name: str, text: Column) -> Column:
        return F.transform(terms_of(text), lambda t: F.struct(t.alias("term"), F.lit(name).alias("w")))

    def placed(tokens: Column) -> Column:
        out = F.transform(tokens, lambda t, i: F.struct(t["term"].alias("term"), t["w"].alias("w"), (i + 1).alias("pos")))
        return out if starts is None else F.filter(out, lambda t: _begins(t, starts))

    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    near = F.concat(zone("A", given(title)), zone("B", given(location)), zone("B", given(department)))
    if description is None:
        return placed(near)
    if texts is None:
        return placed(F.concat(near, zone("C", given(description))))
    body = texts.ask(f"tokens {starts}", lambda text: placed(zone("C", text)))
    def moved(before: Column) -> Column:
        return F.transform(body, lambda t: F.struct(t["term"].alias("term"), t["w"].alias("w"), (t["pos"] + before).alias("pos")))

    # Binding the size to a one-element array keeps it from being worked out for each token.
    return F.concat(placed(near), F.element_at(F.transform(F.array(F.size(near)), moved), 1))


def _begins(token: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda q: token["term"].startswith(q))


def any_rank(tokens: Column, terms: list[str]) -> Column:
    """Rank of an OR query: each hit is a cover of its own, so r is the sum of hit weights."""
    r = F.aggregate(F.filter(tokens, lambda t: _begins(t, terms)), F.lit(0.0), lambda acc, t: acc + _weight(t["w"]))
    return r / (r + 1)


def _weight(zone: Column) -> Column:
    return F.when(zone == "A", ZONE_WEIGHTS["A"]).when(zone == "B", ZONE_WEIGHTS["B"]).otherwise(ZONE_WEIGHTS["C"])


def all_rank(tokens: Column, terms: list[str]) -> Column:
    """Cover-density rank of an AND query over prefix terms.

    A minimal cover is a stretch of hits that holds every term and no shorter stretch inside it
    does: one ends at each hit where the oldest "last seen" position of the terms moves on. A cover
    of n hits adds n / sum(1/weight), damped by 1 + the number of other words between its ends.
    """
    n = len(terms)
    hits = F.filter(
        F.transform(
            tokens,
            lambda t: F.struct(
                t["pos"].alias("pos"),
                (1.0 / _weight(t["w"])).alias("inv"),
                F.array(*[t["term"].startswith(q) for q in terms]).alias("which"),
            ),
        ),
        lambda h: F.array_contains(h["which"], True),
    )
    # `seen[i]`: for term i the latest hit as (position, hits before it, inverse weight before it).
    seen_type = "struct<pos:int,count:int,inv:double>"
    nothing = F.array_repeat(F.lit(None).cast(seen_type), n)
    start = F.struct(
        nothing.alias("seen"),
        F.lit(0).alias("count"),
        F.lit(0.0).alias("inv"),
        F.lit(-1).alias("left"),
        F.lit(0.0).alias("rank"),
    )

    def step(acc: Column, h: Column) -> Column:
        here = F.struct(h["pos"].alias("pos"), acc["count"].alias("count"), acc["inv"].alias("inv")).cast(seen_type)
        seen = F.transform(
            acc["seen"], lambda s, i: F.when(F.element_at(h["which"], i + 1), here).otherwise(s)
        )
        return F.struct(
            seen.alias("seen"),
            (acc["count"] + 1).alias("count"),
            (acc["inv"] + h["inv"]).alias("inv"),
            acc["left"].alias("left"),
            acc["rank"].alias("rank"),
            h["pos"].alias("pos"),
        )

    def close(a: Column) -> Column:
        first = F.array_min(a["seen"])
        full = ~F.exists(a["seen"], lambda s: s.isNull())
        moved = full & (first["pos"] > a["left"])
        hits_in = a["count"] - first["count"]
        noise = (a["pos"] - first["pos"]) - (hits_in - 1)
        gain = hits_in / (a["inv"] - first["inv"]) / (1 + F.when(noise < 0, (hits_in - 1) / 2).otherwise(noise))
        return F.struct(
            a["seen"].alias("seen"),
            a["count"].alias("count"),
            a["inv"].alias("inv"),
            F.when(moved, first["pos"]).otherwise(a["left"]).alias("left"),
            F.when(moved, a["rank"] + gain).otherwise(a["rank"]).alias("rank"),
        )

    def advance(acc: Column, h: Column) -> Column:
        # Binding the new state to a one-element array keeps it from being computed per use.
        return F.element_at(F.transform(F.array(step(acc, h)), close), 1)

    return F.aggregate(hits, start, advance, lambda a: a["rank"] / (a["rank"] + 1))
