"""Profile match: score, hard predicate, exclusions and reasons.

One set of rules serves two callers. `Profile` holds one viewer's wishes as Python values, so absent
wishes add no expression at all; `ProfileColumns` reads them from columns, for all users at once.
Both read the posting from the columns `board_frame` gives.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions import search
from hirelake.functions.search import SharedTexts, Zones
from hirelake.schema import IMPORTANCE

# --- fixed values: points -------------------------------------------------------------
WEIGHTS = {
    "domain": 40, "seniority": 20, "motivation": 15, "resume": 20, "employment_type": 35, "city": 30,
    "country": 20, "remote_fallback": 22, "relocation": 10, "remote_type": 15, "title": 35,
    "keyword": 25, "required": 30, "industry": 15, "salary": 10, "freshness": 10, "followed": 8,
}
ESSENTIAL_MISS_CEILING = 69
STRONG_FIT_SCORE = 70
POSSIBLE_FIT_SCORE = 40

def _lower(values):
    return [v.strip().lower() for v in values if v.strip()]


def _upper(values):
    return [v.strip().upper() for v in values if v.strip()]


@dataclass
class Profile:
    """One viewer's wishes; an empty list is no opinion."""

    user_id: object = None
    domains: list[str] = field(default_factory=list)
    seniorities: list[str] = field(default_factory=list)
    employment_types: list[str] = field(default_factory=list)
    remote_types: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    required_keywords: list[str] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)
    motivations: list[str] = field(default_factory=list)
    resume_keywords: list[str] = field(default_factory=list)
    excluded_keywords: list[str] = field(default_factory=list)
    excluded_company_ids: list = field(default_factory=list)
    min_salary: int | None = None
    salary_currency: str | None = None
    max_age_days: int | None = None
    open_to_relocation: bool = False
    weights: dict[str, str] = field(default_factory=dict)

    def signals(self) -> list[bool]:
        return [
            bool(x)
            for x in (
                self.domains, self.seniorities, self.employment_types, self.remote_types,
                self.countries or self.cities, self.titles, self.keywords, self.required_keywords,
                self.industries, self.motivations, self.resume_keywords, self.min_salary,
                self.max_age_days, self.excluded_keywords or self.excluded_company_ids,
            )
        ]

    @property
    def configured(self) -> bool:
        return any(self.signals())

    @property
    def completeness(self) -> int:
        return int(100 * sum(self.signals()) / len(self.signals()) + 0.5)


class LiteralWishes:
    """`Profile` as the scorer reads it."""

    def __init__(self, p: Profile, zones: Zones | None = None):
        self.p, self.zones = p, zones or Zones()
        self._cities, self._countries = _lower(p.cities), _upper(p.countries)
        self._titles = list(dict.fromkeys(_lower(p.titles)))
        self._terms = {
            k: search.profile_terms(getattr(p, k))
            for k in ("motivations", "resume_keywords", "keywords", "required_keywords", "excluded_keywords")
        }

    def has(self, name: str) -> bool:
        if name in self._terms:
            return bool(self._terms[name])
        own = {"cities": self._cities, "countries": self._countries, "titles": self._titles}
        return bool(own.get(name, getattr(self.p, name)))

    def weight(self, criterion: str) -> float:
        return IMPORTANCE.get(self.p.weights.get(criterion), 1.0)

    def lists(self, name: str, c: Column) -> Column:
        return c.isin(getattr(self.p, name))

    def accepts_remote(self) -> bool:
        return not self.p.remote_types or "REMOTE" in self.p.remote_types

    def relocates(self) -> bool:
        return self.p.open_to_relocation

    def city_hit(self) -> Column:
        return F.arrays_overlap("cities_lower", F.array(*map(F.lit, self._cities))) if self._cities else F.lit(False)

    def country_hit(self) -> Column:
        return F.arrays_overlap("countries_upper", F.array(*map(F.lit, self._countries))) if self._countries else F.lit(False)

    def title_hit(self) -> Column:
        title = F.lower("title")
        return reduce(lambda a, b: a | b, [title.contains(t) for t in self._titles])

    def share(self, name: str) -> Column:
        return search.any_term_share(self.zones, self._terms[name])

    def all_words(self) -> Column:
        return search.matches_all_words(self.zones, self._terms["required_keywords"])

    def any_excluded(self) -> Column:
        return search.matches_any_prefix(self.zones, self._terms["excluded_keywords"])

    def min_salary(self):
        return F.lit(self.p.min_salary)

    def comparable(self) -> Column:
        currency = (self.p.salary_currency or "").strip().upper()
        if not currency:
            return F.lit(True)
        return F.col("salary_currency").isNull() | (F.upper("salary_currency") == currency)

    def max_age(self):
        return F.lit(self.p.max_age_days)


class ColumnWishes:
    """The same wishes read from the columns of a preference row joined to a posting.

    Text wishes come as term arrays (`keywords_terms`, …) and meet the posting's `hits`: for each
    term of the users' vocabulary found in it, whether it is in title or B zone, the first and last
    position in the description, and whether the whole word occurs.
    """

    def has(self, name: str) -> Column:
        if name in ("min_salary", "max_age_days"):
            return F.coalesce(F.col(name) > 0, F.lit(False))
        own = {
            "motivations": "motivations_terms", "resume_keywords": "resume_keywords_terms",
            "keywords": "keywords_terms", "required_keywords": "required_keywords_terms",
            "excluded_keywords": "excluded_keywords_terms", "cities": "wish_cities",
            "countries": "wish_countries", "titles": "wish_titles",
        }
        return F.coalesce(F.size(F.col(own.get(name, name))) > 0, F.lit(False))

    def weight(self, criterion: str) -> Column:
        level = F.try_element_at(F.col("weights"), F.lit(criterion))
        points = F.when(level == "IGNORED", 0.0).when(level == "NICE_TO_HAVE", 0.5)
        return points.when(level == "ESSENTIAL", 2.0).otherwise(1.0)

    def lists(self, name: str, c: Column) -> Column:
        return F.array_contains(F.col(name), c)

    def accepts_remote(self) -> Column:
        return ~self.has("remote_types") | F.array_contains("remote_types", "REMOTE")

    def relocates(self) -> Column:
        return F.coalesce(F.col("open_to_relocation"), F.lit(False))

    def city_hit(self) -> Column:
        return F.coalesce(F.arrays_overlap("cities_lower", "wish_cities"), F.lit(False))

    def country_hit(self) -> Column:
        return F.coalesce(F.arrays_overlap("countries_upper", "wish_countries"), F.lit(False))

    def title_hit(self) -> Column:
        return F.exists("wish_titles", lambda t: F.lower("title").contains(t))

    def _hits(self, name: str) -> Column:
        found = F.transform(f"{name}_terms", lambda t: F.try_element_at(F.col("hits"), t))
        return F.filter(found, lambda h: h.isNotNull())

    def share(self, name: str) -> Column:
        hits = self._hits(name)
        first = F.array_min(F.transform(hits, lambda h: h["first"]))
        last = F.array_max(F.transform(hits, lambda h: h["last"]))
        return (
            F.when(F.exists(hits, lambda h: h["near"]) | (first < last), F.lit(1.0))
            .when(first.isNotNull(), F.lit(2.0 / 3.0))
            .otherwise(F.lit(0.0))
        )

    def all_words(self) -> Column:
        return F.coalesce(
            F.forall(
                "required_keywords_terms",
                lambda t: F.coalesce(F.try_element_at(F.col("hits"), t)["whole"], F.lit(False)),
            ),
            F.lit(False),
        )

    def any_excluded(self) -> Column:
        return F.coalesce(F.size(self._hits("excluded_keywords")) > 0, F.lit(False))

    def min_salary(self) -> Column:
        return F.col("min_salary")

    def comparable(self) -> Column:
        currency = F.upper(F.trim(F.coalesce(F.col("wish_currency"), F.lit(""))))
        return (currency == "") | F.col("salary_currency").isNull() | (F.upper("salary_currency") == currency)

    def max_age(self) -> Column:
        return F.col("max_age_days")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _never(x) -> bool:
    """True when a wish is known absent while the expression is built."""
    return isinstance(x, (bool, int, float)) and not x


def _location(wishes) -> tuple:
    has = [wishes.has("cities"), wishes.has("countries")]
    present = has[0] or has[1] if isinstance(has[0], bool) else has[0] | has[1]
    remote = _c(wishes.accepts_remote()) & F.coalesce(F.col("remote_type") == "REMOTE", F.lit(False))
    return present, F.coalesce(wishes.city_hit(), F.lit(False)), F.coalesce(wishes.country_hit(), F.lit(False)), remote


def _pays(wishes) -> Column:
    """Either end of the range reaches the wish."""
    wanted = wishes.min_salary()
    return F.coalesce(F.col("salary_max") >= wanted, F.lit(False)) | F.coalesce(
        F.col("salary_min") >= wanted, F.lit(False)
    )


def match_score(wishes, follows_any, as_of: Column) -> Column | None:
    """0..100, or None when nothing can be scored.

    Points earned over points attainable; a criterion the posting says nothing about is not
    attainable. Halves round up. A contradicted ESSENTIAL wish caps the score at 69.
    """
    parts: list[tuple[Column, Column]] = []
    caps: list[Column] = []

    def add(present, weight, earned: Column, points: int, attainable: Column | None = None, missed: Column | None = None):
        """One criterion: points earned, points attainable, and what contradicts it."""
        if _never(present) or _never(weight):
            return
        gate = _c(present)
        reach = gate if attainable is None else gate & attainable
        parts.append(
            (F.when(gate, earned * _c(weight)).otherwise(0.0), F.when(reach, points * _c(weight)).otherwise(0.0))
        )
        if missed is not None and not (isinstance(weight, float) and weight < 2.0):
            caps.append(F.when(gate & (_c(weight) >= 2.0) & missed, ESSENTIAL_MISS_CEILING).otherwise(100))

    def one_of(name: str, column: str, criterion: str, points: int, capped: bool = True):
        if _never(wishes.has(name)):
            return
        known = F.col(column).isNotNull()
        inside = F.coalesce(wishes.lists(name, F.col(column)), F.lit(False))
        add(
            wishes.has(name), wishes.weight(criterion), F.when(inside, points).otherwise(0), points, known,
            known & ~inside if capped else None,
        )

    def text(name: str, criterion: str, points: int):
        if not _never(wishes.has(name)):
            add(wishes.has(name), wishes.weight(criterion), points * wishes.share(name), points)

    one_of("domains", "domain", "DOMAIN", WEIGHTS["domain"])
    one_of("seniorities", "seniority", "SENIORITY", WEIGHTS["seniority"])
    text("motivations", "MOTIVATION", WEIGHTS["motivation"])
    text("resume_keywords", "RESUME", WEIGHTS["resume"])
    one_of("employment_types", "employment_type", "EMPLOYMENT_TYPE", WEIGHTS["employment_type"])
    present, city, country, remote = _location(wishes)
    if not _never(present):
        known, moves = F.col("place_known"), _c(wishes.relocates())
        ladder = (
            F.when(city, WEIGHTS["city"])
            .when(country, WEIGHTS["country"])
            .when(remote, WEIGHTS["remote_fallback"])
            .when(known & moves, WEIGHTS["relocation"])
            .otherwise(0)
        )
        add(
            present, wishes.weight("LOCATION"), ladder, WEIGHTS["city"], known,
            ~moves & known & ~(city | country | remote),
        )
    one_of("remote_types", "remote_type", "REMOTE_TYPE", WEIGHTS["remote_type"])
    if not _never(wishes.has("titles")):
        hit = F.when(wishes.title_hit(), WEIGHTS["title"]).otherwise(0)
        add(wishes.has("titles"), wishes.weight("TITLE"), hit, WEIGHTS["title"])
    text("keywords", "KEYWORDS", WEIGHTS["keyword"])
    if not _never(wishes.has("required_keywords")):
        hit = F.when(wishes.all_words(), WEIGHTS["required"]).otherwise(0)
        add(wishes.has("required_keywords"), 1.0, hit, WEIGHTS["required"])
    one_of("industries", "industry", "INDUSTRY", WEIGHTS["industry"], capped=False)
    if not _never(wishes.has("min_salary")):
        priced = F.coalesce(F.col("salary_max"), F.col("salary_min")).isNotNull() & wishes.comparable()
        hit = F.when(priced & _pays(wishes), WEIGHTS["salary"]).otherwise(0)
        add(wishes.has("min_salary"), wishes.weight("SALARY"), hit, WEIGHTS["salary"], priced)
    if not _never(wishes.has("max_age_days")):
        posted = F.col("posted_at")
        age = (
            F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(posted.cast("timestamp"))
        ) / 1e6 / 86400.0
        fresh = F.greatest(F.lit(0.0), 1.0 - age / (wishes.max_age() * 2.0))
        add(
            wishes.has("max_age_days"), wishes.weight("FRESHNESS"),
            F.when(posted.isNull(), 0.0).otherwise(WEIGHTS["freshness"] * fresh),
            WEIGHTS["freshness"], posted.isNotNull(),
        )
    followed = F.coalesce(F.col("followed"), F.lit(False))
    add(follows_any, 1.0, F.when(followed, WEIGHTS["followed"]).otherwise(0), WEIGHTS["followed"])

    if not parts:
        return None
    earned = reduce(lambda a, b: a + b, [p for p, _ in parts])
    attainable = reduce(lambda a, b: a + b, [m for _, m in parts])
    score = F.greatest(F.lit(0), F.coalesce(F.round(earned * 100.0 / F.nullif(attainable, F.lit(0.0))), F.lit(0.0)))
    return F.least(F.lit(100), *caps, score).cast("int")


def match_predicate(wishes) -> Column | None:
    """The hard filter of a profile; an attribute the posting does not state passes."""
    clauses: list[Column] = []

    def when_present(present, weight, clause: Column):
        if _never(present) or _never(weight):
            return
        asked = _c(present) & (_c(weight) > 0)
        clauses.append(~asked | clause)

    for name, column, criterion in (
        ("domains", "domain", "DOMAIN"),
        ("seniorities", "seniority", "SENIORITY"),
        ("employment_types", "employment_type", "EMPLOYMENT_TYPE"),
        ("remote_types", "remote_type", "REMOTE_TYPE"),
        ("industries", "industry", "INDUSTRY"),
    ):
        if not _never(wishes.has(name)):
            c = F.col(column)
            when_present(wishes.has(name), wishes.weight(criterion), c.isNull() | wishes.lists(name, c))

    present, city, country, remote = _location(wishes)
    if not _never(present) and wishes.relocates() is not True:
        stays = ~_c(wishes.relocates())
        when_present(
            _c(present) & stays, wishes.weight("LOCATION"), city | country | remote | ~F.col("place_known")
        )
    if not _never(wishes.has("required_keywords")):
        when_present(wishes.has("required_keywords"), 1.0, wishes.all_words())
    if not _never(wishes.has("min_salary")):
        unpriced = F.coalesce(F.col("salary_max"), F.col("salary_min")).isNull()
        when_present(
            wishes.has("min_salary"), wishes.weight("SALARY"), unpriced | ~wishes.comparable() | _pays(wishes)
        )
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def exclusion(wishes) -> Column | None:
    """Keeps postings without an excluded keyword and outside the excluded companies."""
    clauses = []
    if not _never(wishes.has("excluded_keywords")):
        clauses.append(~wishes.any_excluded())
    if not _never(wishes.has("excluded_company_ids")):
        clauses.append(~F.coalesce(wishes.lists("excluded_company_ids", F.col("company_id")), F.lit(False)))
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def score_band(score: Column) -> Column:
    return (
        F.when(score >= STRONG_FIT_SCORE, "Strong")
        .when(score >= POSSIBLE_FIT_SCORE, "Worth")
        .when(score.isNotNull(), "Long")
    )


def match_reasons(
    p: Profile,
    titles: int | None = None,
    required: int | None = None,
    keywords: int | None = None,
    motivations: int | None = None,
    resume: int | None = None,
    texts: SharedTexts | None = None,
) -> Column:
    """array<struct<kind, label, met>> in display order, by substring on title and description.

    `titles` is how many wished titles are looked at, the others how many words of a kind are named; all unless given.
    """
    kind = "array<struct<kind:string,label:string,met:boolean>>"
    if not p.configured:
        return F.array().cast(kind)
    groups: list[Column] = []

    def reason(name: str, label: Column, met: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), label.alias("label"), F.coalesce(met, F.lit(False)).alias("met"))

    def one(condition: Column, value: Column) -> None:
        groups.append(F.when(condition, F.array(value)).otherwise(F.array().cast(kind)))

    def muted(criterion: str) -> bool:
        return IMPORTANCE.get(p.weights.get(criterion), 1.0) <= 0

    def readable(column: str) -> Column:
        return F.regexp_replace(F.lower(column), "_", " ")

    for name, column, wanted, criterion in (
        ("domain", "domain", p.domains, "DOMAIN"),
        ("seniority", "seniority", p.seniorities, "SENIORITY"),
        ("employmentType", "employment_type", p.employment_types, "EMPLOYMENT_TYPE"),
    ):
        if wanted and not muted(criterion):
            label = F.lower(column) if name == "seniority" else readable(column)
            one(F.col(column).isNotNull(), reason(name, label, F.col(column).isin(wanted)))

    cities, countries = _lower(p.cities), _upper(p.countries)
    city = F.get(F.filter("city_list", lambda c: F.lower(c).isin(cities)), F.lit(0)) if cities else F.lit(None)
    if cities:
        one(city.isNotNull(), reason("city", city, F.lit(True)))
    if countries:
        country = F.get(F.filter("country_list", lambda c: F.upper(c).isin(countries)), F.lit(0))
        one(city.isNull() & country.isNotNull(), reason("country", country, F.lit(True)))
    if p.remote_types:
        one(F.col("remote_type").isNotNull(), reason("remote", readable("remote_type"), F.col("remote_type").isin(p.remote_types)))
    for wanted in p.titles[:titles]:
        term = wanted.strip().lower()
        if term:
            one(F.lower("title").contains(term), reason("title", F.lit(wanted), F.lit(True)))

    words = (
        ("required", p.required_keywords, required),
        ("keyword", p.keywords, keywords),
        ("motivation", p.motivations, motivations),
        ("resume", p.resume_keywords, resume),
    )
    if texts is None:
        haystack = F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("description", F.lit(""))))
        said = haystack.contains
    else:
        # A word may begin in the title and end in the text, so the title is read with as much of the text as it can reach.
        reach = max((len(v) for _, values, _ in words for v in values), default=0)
        head = texts.ask(f"first {reach}", lambda text: F.substring(F.lower(text), 1, reach))
        haystack = F.lower(F.concat(F.col("title"), F.lit(" "))) if not reach else F.concat(F.lower("title"), F.lit(" "), head)

        def said(v: str) -> Column:
            inside = texts.ask(f"contains {v}", lambda text: F.lower(text).contains(v))
            return F.col("title").isNotNull() & (haystack.contains(v) | inside)

    for name, values, cap in words:
        if values:
            found = [F.when(said(v.strip().lower()), reason(name, F.lit(v), F.lit(True))) for v in values]
            named = F.array_compact(F.array(*found))
            groups.append(named if cap is None else F.slice(named, 1, cap))
    if p.industries:
        one(F.col("industry").isNotNull(), reason("industry", readable("industry"), F.col("industry").isin(p.industries)))
    if p.min_salary:
        high = F.col("salary_max")
        label = F.concat(F.floor(high / 1000 + 0.5).cast("string"), F.lit("k"))
        one(high > 0, reason("salary", label, high >= p.min_salary))
    one(F.coalesce(F.col("followed"), F.lit(False)), reason("followed", F.lit("Followed"), F.lit(True)))
    return F.concat(*groups)
