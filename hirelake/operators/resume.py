"""Profiles from CV text: one narrow job over (user_id, text) rows, no shuffle.

A CV is at most 40 000 characters, so its lines are handled as an array inside the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.places import with_places
from hirelake.functions.roles import classify_domain, classify_seniority
from hirelake.functions.text import WS, WS_CHARS, bind, first_of, fold_accents, matches, searched, trim_ws, words

# --- fixed values: the skill list, in reading order ------------------------------------
SKILLS = [
    # languages
    "typescript", "javascript", "python", "java", "kotlin", "swift", "go", "golang", "rust", "c++",
    "c#", "ruby", "php", "scala", "elixir", "haskell", "sql", "bash", "r", "matlab", "dart", "perl",
    "lua", "solidity",
    # front end
    "react", "next.js", "nextjs", "vue", "nuxt", "angular", "svelte", "remix", "tailwind", "css",
    "html", "redux", "webpack", "vite", "storybook", "react native", "flutter", "swiftui",
    "jetpack compose",
    # back end
    "node.js", "nodejs", "express", "nestjs", "django", "flask", "fastapi", "rails", "spring",
    "spring boot", "laravel", "symfony", ".net", "graphql", "rest", "grpc", "microservices", "kafka",
    "rabbitmq", "redis", "celery",
    # data
    "postgresql", "postgres", "mysql", "mongodb", "elasticsearch", "cassandra", "dynamodb",
    "snowflake", "bigquery", "redshift", "databricks", "spark", "hadoop", "airflow", "dbt",
    "kafka streams", "clickhouse", "duckdb", "pandas", "numpy", "etl",
    # machine learning
    "machine learning", "deep learning", "pytorch", "tensorflow", "keras", "scikit-learn",
    "hugging face", "transformers", "llm", "nlp", "computer vision", "reinforcement learning",
    "mlops", "langchain", "rag",
    # infrastructure
    "aws", "gcp", "azure", "kubernetes", "docker", "terraform", "ansible", "pulumi", "jenkins",
    "github actions", "gitlab ci", "circleci", "linux", "nginx", "prometheus", "grafana", "datadog",
    "ci/cd", "serverless",
    # security
    "penetration testing", "owasp", "cryptography", "oauth", "saml", "iam", "threat modeling",
    "siem", "soc",
    # practice
    "agile", "scrum", "kanban", "tdd", "code review", "system design", "distributed systems",
    "accessibility", "seo", "a/b testing", "product management", "user research", "figma", "ux",
    "ui design", "data analysis", "unit testing", "e2e testing", "cypress", "playwright", "jest",
    "pytest",
]
# Short names that count only when clearly set apart.
AMBIGUOUS_SKILLS = {"r", "go", "rest", "ux", "soc", "rag", "iam"}

# --- fixed values: patterns -----------------------------------------------------------
EXPERIENCE_HEADING = r"^(work\s+|professional\s+)?(experience|experiences|employment|emploi|exp[eé]riences?(\s+professionnelles?)?|parcours(\s+professionnel)?|career)\s*:?\s*$"
OTHER_HEADING = r"^(education|formation|dipl[oô]mes?|skills|comp[eé]tences|projects|projets|languages|langues|certifications?|interests|centres?\s+d.int[eé]r[eê]ts?|publications|awards|r[eé]f[eé]rences|volunteer|associatif)\b"
SCHOOL = r"\b(universit|école|ecole|school|college|institut|lyc[eé]e|bachelor|master['’]?s?|licence|bts|but\b|dut\b|mba|phd|doctorat|dipl[oô]m|degree|baccalaur)\b"
TITLE_SEPARATORS = r"\s[–—|·•@]\s|\s[-–]\s|\s\bchez\b\s|\s\bat\b\s|,\s"
DATE_RANGE = r"\b((?:19|20)\d{2})\s*(?:[-–—]|to|à|a|jusqu'?[àa]|until)\s*((?:19|20)\d{2}|pr[ée]sent|current|today|aujourd'?hui|now|en cours|ongoing)\b"
CONTRACT_PATTERNS = [
    (r"\b(alternan\w*|apprenti\w*|apprenticeship|contrat\s+pro\w*|ausbildung|work[-\s]?study)\b", "APPRENTICESHIP"),
    (r"\b(stage|stagiaire|internship|intern\b|praktikum|working\s+student)\b", "INTERNSHIP"),
    (r"\b(freelance|auto[-\s]?entrepreneur|independent\s+contractor|self[-\s]?employed)\b", "FREELANCE"),
    (r"\b(cdi|permanent|full[-\s]?time|temps\s+plein)\b", "FULL_TIME"),
    (r"\b(cdd|fixed[-\s]?term|temporary|int[eé]rim|mission)\b", "TEMPORARY"),
    (r"\b(part[-\s]?time|temps\s+partiel)\b", "PART_TIME"),
]
STUDENT = r"\b([eé]tudiant\w*|student|[eé]l[eè]ve\s+ing[eé]nieur|engineering\s+student|en\s+formation|m1\b|m2\b|master\s*[12]\b|cycle\s+ing[eé]nieur)\b"
LOCATION_HINT = r"^(location|localisation|adresse|address|based\s+in|bas[eé]\s+[àa]|ville|city)\s*:?\s*"
CONTACT_NOISE = r"(\S+@\S+|https?:\/\/\S+|(?:www|linkedin|github)\.\S+|\+?\d[\d\s().-]{7,})"

_TEXTS = "array<string>"


def normalise_resume_text(c: Column, length: int | None = None) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"[ \t]+", " ")
    whole = trim_ws(F.regexp_replace(t, "\n{3,}", "\n\n"))
    return whole if length is None else F.substring(whole, 1, length)


def skill_pattern(skill: str) -> str:
    edge = "a-z0-9+#." if skill in AMBIGUOUS_SKILLS else "a-z0-9"
    return rf"(?:\A|[^{edge}]){re.escape(skill).replace('/', '[/]')}(?:[^{edge}]|\z)"


def extract_keywords(text: Column, limit: int | None = None) -> Column:
    """Known skills the text names, in list order, all or at most `limit`."""
    # A plain search of the name first: few names are there at all, and only those are worth the pattern.
    named = lambda lower, s: F.when(lower.contains(s) & lower.rlike(skill_pattern(s)), F.lit(s))
    found = bind(F.lower(text), lambda lower: F.array_compact(F.array(*[named(lower, s) for s in SKILLS])))
    return first_of(found, limit)


def _lines(text: Column) -> Column:
    bare = F.transform(
        F.split(text, "\n"), lambda v: trim_ws(F.regexp_replace(v, rf"\A[{WS_CHARS}•·*\-–—]+", ""))
    )
    return F.filter(bare, lambda v: F.length(v) > 0)


def with_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `lines`, `experience` (between its heading and the next) and `scope` (that, else all)."""
    df = df.withColumn("lines", F.coalesce(_lines(F.col(text)), F.array().cast(_TEXTS)))
    start = F.array_position(F.transform("lines", lambda v: matches(v, EXPERIENCE_HEADING)), True)
    df = df.withColumn(
        "experience",
        F.when(start > 0, F.slice("lines", start.cast("int") + 1, F.size("lines"))).otherwise(F.array().cast(_TEXTS)),
    )
    end = F.array_position(F.transform("experience", lambda v: matches(v, OTHER_HEADING)), True)
    df = df.withColumn(
        "experience", F.when(end > 0, F.slice("experience", 1, end.cast("int") - 1)).otherwise(F.col("experience"))
    )
    return df.withColumn("scope", F.when(F.size("experience") > 0, F.col("experience")).otherwise(F.col("lines")))


def _title_text(line: Column) -> Column:
    t = F.element_at(F.split(line, words(TITLE_SEPARATORS)), 1)
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.regexp_replace(t, words(r"\b(?:19|20)\d{2}\b"), " ")
    t = F.regexp_replace(t, f"{WS}{{2,}}", " ")
    return trim_ws(F.regexp_replace(t, rf"[,;:.{WS_CHARS}]+\z", ""))


def with_titles(df: DataFrame, most: int | None = None) -> DataFrame:
    """Adds `roles` (struct<title, domain, seniority>, all or `most`, distinct by folded text)."""
    readable = F.filter(
        "scope",
        lambda v: (F.length(v) <= 90)
        & ~matches(v, SCHOOL)
        & ~v.rlike(r"[.!?]\z")
        & (F.length(v) - F.length(F.replace(v, F.lit(","), F.lit(""))) <= 3),
    )
    df = df.withColumn("_t", F.transform(readable, _title_text))
    df = df.withColumn(
        "_t",
        F.filter(
            "_t", lambda t: F.length(t).between(3, 70) & (F.size(F.split(t, f"{WS}+")) <= 9)
        ),
    )
    df = df.withColumn(
        "_t",
        F.transform(
            "_t",
            lambda t: F.struct(
                t.alias("title"), classify_domain(t).alias("domain"), classify_seniority(t).alias("seniority"),
                F.lower(fold_accents(t)).alias("key"),
            ),
        ),
    )
    df = df.withColumn("_t", F.filter("_t", lambda t: t["domain"].isNotNull()))
    df = df.withColumn("_keys", F.transform("_t", lambda t: t["key"]))
    first = F.filter(
        "_t", lambda t, i: F.array_position(F.col("_keys"), F.element_at(F.col("_keys"), i + 1)) == i + 1
    )
    return df.withColumn("roles", first_of(first, most)).drop("_t", "_keys")


def top_domains(titles: Column, most: int | None = None) -> Column:
    """The domains of the titles, those that most share first; the first seen wins a tie."""
    domains = F.transform(titles, lambda t: t["domain"])
    counted = F.transform(
        F.array_distinct(domains),
        lambda d: F.struct(
            (-F.size(F.filter(domains, lambda x: x == d))).alias("n"), F.array_position(domains, d).alias("at"), d.alias("d")
        ),
    )
    return first_of(F.transform(F.array_sort(counted), lambda c: c["d"]), most)


def years_of_experience(scope: Column, as_of: Column) -> Column:
    """First to last year of the date ranges, 0..50; NULL without any."""
    text = F.array_join(scope, "\n")
    this_year = F.year(as_of)
    starts = F.regexp_extract_all(text, F.lit(words(DATE_RANGE)), F.lit(1))
    ends = F.regexp_extract_all(text, F.lit(words(DATE_RANGE)), F.lit(2))
    ranges = F.filter(
        F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda r: F.struct(
                r["a"].try_cast("int").alias("first"), F.coalesce(r["b"].try_cast("int"), this_year).alias("last")
            ),
        ),
        lambda r: r["first"].between(1970, this_year),
    )
    span = F.array_max(F.transform(ranges, lambda r: r["last"])) - F.array_min(F.transform(ranges, lambda r: r["first"]))
    return F.when(span.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(50), span)))


def seniorities(titles: Column, years: Column, text: Column, most: int | None = None) -> Column:
    """Levels the titles state; students start at the bottom; years only where titles say nothing."""
    stated = F.filter(F.transform(titles, lambda t: t["seniority"]), lambda s: s.isNotNull())
    student = matches(text, STUDENT) | F.array_contains(stated, "INTERN")
    pair = lambda *v: F.array(*map(F.lit, v))
    by_years = (
        F.when(years < 1, pair("INTERN", "JUNIOR"))
        .when(years < 3, pair("JUNIOR", "MID"))
        .when(years < 6, pair("MID", "SENIOR"))
        .when(years < 9, pair("SENIOR", "LEAD"))
        .when(years.isNotNull(), pair("LEAD"))
        .otherwise(F.array().cast(_TEXTS))
    )
    levels = F.when(student, F.concat(pair("INTERN", "JUNIOR"), stated)).when(F.size(stated) > 0, stated).otherwise(by_years)
    return first_of(F.array_distinct(levels), most)


def contracts(text: Column, most: int | None = None) -> Column:
    found = searched(text, lambda has: F.array_compact(F.array(*[F.when(has(p), label) for p, label in CONTRACT_PATTERNS])))
    return first_of(found, most)


def with_cv_places(df: DataFrame, head_lines: int | None = None, most: int | None = None) -> DataFrame:
    """Adds `cities` and `countries` the CV names, in the order of its lines (or the first `head_lines`), lines that state
    a place, experience; unrecognised cities are dropped."""
    hinted = F.filter("lines", lambda v: matches(v, LOCATION_HINT))
    noise = words(CONTACT_NOISE).replace(r"\S", f"[^{WS_CHARS}]")
    candidates = F.filter(
        F.transform(
            F.concat(first_of(F.col("lines"), head_lines), hinted, F.col("experience")),
            lambda v: F.regexp_replace(F.regexp_replace(v, words(LOCATION_HINT), ""), noise, " "),
        ),
        lambda v: (F.length(trim_ws(v)) > 1) & (F.length(v) < 80),
    )
    df = with_places(df.withColumn("_near", candidates), F.col("_near"), "_found").drop("_near")
    known = F.filter("_found", lambda p: p["country"].isNotNull())
    cities = F.filter(F.transform(known, lambda p: p["city"]), lambda c: c.isNotNull())
    return df.withColumns(
        {
            "cities": first_of(F.array_distinct(cities), most),
            "countries": first_of(F.array_distinct(F.transform(known, lambda p: F.upper(p["country"]))), most),
        }
    ).drop("_found")


def extract_profiles(cvs: DataFrame, as_of: Column, text: str = "text") -> DataFrame:
    """Adds the profile fields to (user_id, text) rows."""
    keep = [c for c in cvs.columns if c != text]
    df = with_cv_places(with_titles(with_sections(cvs, text)))
    df = df.withColumn("years", years_of_experience(F.col("scope"), as_of))
    body = F.col(text)
    return df.select(
        *keep,
        F.transform("roles", lambda t: t["title"]).alias("titles"),
        top_domains(F.col("roles")).alias("domains"),
        seniorities(F.col("roles"), F.col("years"), body).alias("seniorities"),
        contracts(body).alias("employment_types"),
        "cities",
        "countries",
        extract_keywords(body).alias("keywords"),
        F.col("years").alias("years_of_experience"),
    )
