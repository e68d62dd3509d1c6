"""Personal data: patterns propose spans, checksums confirm them, context words move their score. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
# Equal to the plain patterns of the contract, written so that no text costs more than linear time: a run is entered at
# its start (or where the last match ended) and never given back, as nothing that follows a run could stand inside it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Where an IBAN may begin, and all that may belong to it; `ibans` settles where it ends.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_RUN = r"\A[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+"
IBAN_LONGEST = 64
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
SHORT_CARD = r"(?<![0-9.+-])(?<![0-9]\x20)[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|address|host|server)\b",
    "card": r"(?i)\b(card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|telephone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer|konto|compte|cuenta)\b",
}
BASE_KINDS = ["email", "ip", "card", "phone"]
EXTRA_KINDS = ["iban", "short_card", "local_phone"]
CONTEXT_WIDTH = 40


def proposed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    nothing = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    parts = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step)["out"]
    return F.when(F.size(hits) > 0, found).otherwise(nothing)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Every second digit from the right counts twice, less nine where that exceeds nine; the sum ends in 0."""
    digits = F.reverse(F.split(digits_of(hit), ""))

    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), value), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def mod97(hit: Column) -> Column:
    """Country and check digits moved to the end, letters read as 10 to 35: the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(hit, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    characters = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(characters, F.lit(0), step) == 1


def ibans(text: Column, heads: Column) -> Column:
    """Spans of the IBANs that begin at the heads; none overlaps an earlier one.

    A number ends where no letter or digit follows and its checksum holds: at its country's length, else as late as it can.
    Whatever comes after it (a BIC, a capitalised word, a date) thus leaves it as it is.
    """
    country = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)])

    def number(s: Column) -> Column:
        around = F.substring(text, s["start"] + 1, F.lit(IBAN_LONGEST + 1))
        run = F.regexp_extract(around, IBAN_RUN, 0)
        first = lambda n: F.substring(run, F.lit(1), n)
        size = lambda n: F.length(F.replace(first(n), F.lit(" "), F.lit("")))

        def ends(n: Column) -> Column:
            bound = ~F.substring(around, n, F.lit(2)).rlike(r"[A-Za-z0-9]{2}|\A\x20")
            return (n <= F.length(run)) & bound & (size(n) >= 15) & mod97(first(n))

        every = F.filter(F.sequence(F.lit(IBAN_LONGEST), F.lit(15), F.lit(-1)), ends)
        usual = F.filter(every, lambda n: size(n) == country[F.substring(run, 1, 2)])
        n = F.coalesce(F.get(usual, F.lit(0)), F.get(every, F.lit(0)))
        return F.struct(s["start"].alias("start"), (s["start"] + n).alias("end"), first(n).alias("hit"))

    nothing = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    found = F.filter(F.transform(heads, number), lambda s: s["end"].isNotNull())
    apart = lambda done, s: F.when(F.exists(done, lambda d: s["start"] < d["end"]), done).otherwise(F.concat(done, F.array(s)))
    return F.when(F.size(heads) > 0, F.aggregate(found, nothing, apart)).otherwise(nothing)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _checks() -> dict[str, tuple[str, Column | None, object, float]]:
    """kind: pattern, what a text must hold for it, the check of a match (see `ibans` for theirs), the score of a confirmed span."""
    n = lambda h: F.length(digits_of(h))
    octets = lambda h: F.forall(F.split(h, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit(256)) <= 255)
    return {
        "email": (EMAIL, "@", lambda h: F.lit(True), 0.9),
        "ip": (IP, "digit", octets, 0.7),
        "card": (CARD, "digit", lambda h: _between(n(h), 16, 19) & luhn(h), 0.9),
        "phone": (PHONE, "+", lambda h: _between(n(h), 8, 15), 0.7),
        "iban": (IBAN, "digit", None, 0.9),
        "short_card": (SHORT_CARD, "digit", luhn, 0.4),
        "local_phone": (LOCAL_PHONE, "digit", lambda h: F.lit(True), 0.4),
    }


def _with_spans(rows: DataFrame, least_score: float, context_bonus: float) -> DataFrame:
    """(row, t) to (row, t, pii)."""
    held = {"@": F.contains("t", F.lit("@")), "+": F.contains("t", F.lit("+")), "digit": F.col("t").rlike("[0-9]")}
    nothing = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    checks = _checks()
    rows = rows.withColumns({f"has_{i}": c for i, c in enumerate(held.values())})
    flag = {k: F.col(f"has_{i}") for i, k in enumerate(held)}
    rows = rows.withColumns(
        {k: F.when(flag[need], proposed(F.col("t"), pattern)).otherwise(nothing) for k, (pattern, need, _, _) in checks.items()}
    )

    def confirmed(kind: str) -> Column:
        if kind == "iban":
            return ibans(F.col("t"), F.col(kind))
        return F.filter(kind, lambda s: checks[kind][2](s["hit"]))

    rows = rows.withColumns({k: confirmed(k) for k in checks})

    def scored(kind: str) -> Column:
        words = CONTEXT[kind.rpartition("_")[2]]

        def near(s: Column) -> Column:
            begin = F.greatest(s["start"] - CONTEXT_WIDTH, F.lit(0))
            around = F.substring(F.col("t"), begin + 1, s["end"] - begin + CONTEXT_WIDTH)
            bonus = F.when(around.rlike(words), context_bonus).otherwise(0.0)
            score = F.round(F.least(F.lit(checks[kind][3]) + bonus, F.lit(1.0)), 2)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

        return F.transform(kind, near)

    rows = rows.withColumns({k: scored(k) for k in checks})
    base = F.concat(*BASE_KINDS)
    rows = rows.withColumn("base", base)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    extra = [F.filter(k, lambda s: (s["score"] >= least_score) & free(s)) for k in EXTRA_KINDS]
    return rows.select("row", "t", F.concat("base", *extra).alias("pii"))


def with_spans(docs: DataFrame, least_score: float = 0.6, context_bonus: float = 0.3) -> DataFrame:
    """`docs` with one more column `pii`: array<struct<kind, start, end, score>>, by kind as listed, then start.

    Email, ip, card and phone are found by pattern and checksum alone and all stay; a context word of their kind within
    CONTEXT_WIDTH characters raises their score. Beyond them an IBAN counts where its checksum holds, and a card number of
    13 to 15 digits or a phone number without country code where, with the context, the score reaches `least_score`;
    these never overlap a base span.

    Null text: no span. Empty and long texts: searched whole, in linear time. Repeated rows: each. Null in any other
    column: kept. Empty table: no rows. A column named like a helper stays as it is, since all columns travel in a struct;
    a column `pii` of the input is replaced.
    """
    kept = [c for c in docs.columns if c != "pii"]
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    return _with_spans(rows, least_score, context_bonus).select("row.*", "pii")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans, scores) per document."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redacted(docs: DataFrame, least_score: float = 0.6, context_bonus: float = 0.3) -> DataFrame:
    """`docs` with each span of the text replaced by its kind in angle brackets; overlapping spans become one.

    n_chars, where there is such a column, follows the new text; a null text stays null.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    found = _with_spans(rows, least_score, context_bonus)
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(F.col("t"), done["at"] + 1, s["a"] - done["at"])
        added = F.concat(done["out"], between, F.lit("<"), F.upper(s["k"]), F.lit(">"))
        inside = s["a"] < done["at"]
        return F.struct(
            F.greatest(done["at"], s["b"]).alias("at"), F.when(inside, done["out"]).otherwise(added).alias("out")
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate(order, begin, step, lambda d: F.concat(d["out"], F.substr("t", d["at"] + 1)))
    found = found.select("row", F.size("pii").alias("n"), F.when(F.size("pii") > 0, text).alias("new"))
    changed = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return found.select(F.when(F.col("n") > 0, changed).otherwise(F.col("row")).alias("row")).select("row.*")
