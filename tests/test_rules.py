"""Row rules on hand-made inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelake.functions import roles, text, urls
from hirelake.functions.markup import sanitize_html
from hirelake.functions.places import with_places
from hirelake.operators import resume as rs


def values(spark, inputs, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v")).alias("x")).collect()]


def test_titles(spark):
    raw = ["  Senior  Engineer (3) ", "– Data Analyst |", "Chef de projet NEW!", "R&amp;D Engineer"]
    assert values(spark, raw, roles.clean_title) == ["Senior Engineer", "Data Analyst", "Chef de projet", "R&D Engineer"]
    kept = ["Data Engineer", "Développeur Java", "Ingénieur"]
    dropped = ["Sign in", "Mentions légales", "My jobs", "42", "ab", "12345", "Apply here", "Read more about us", "This is a long sentence about our very nice jobs."]
    assert all(values(spark, kept, roles.is_plausible_title))
    assert not any(values(spark, dropped, roles.is_plausible_title))


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("€45k - €55k per year", (45000, 55000, "EUR")),
        ("Salary: $120,000 to $150,000", (120000, 150000, "USD")),
        ("£40.000 – £50.000", (40000, 50000, "GBP")),
        ("15 to 20 an hour", (None, None, None)),
        ("60k - 50k", (None, None, None)),
        ("no figures", (None, None, None)),
    ],
)
def test_salary(spark, raw, expected):
    assert tuple(values(spark, [raw], roles.parse_salary)[0]) == expected


def test_classification(spark):
    titles = ["Machine Learning Engineer", "Sécurité réseau", "iOS Engineer", "Gardener", "Full-stack developer"]
    assert values(spark, titles, roles.classify_domain) == ["MACHINE_LEARNING", "SECURITY", "MOBILE", None, "FULLSTACK"]
    levels = ["Senior Engineering Manager", "Product Manager", "Stage développement", "Lead Designer", "Stagé"]
    assert values(spark, levels, roles.classify_seniority) == ["MANAGER", None, "INTERN", "LEAD", "INTERN"]
    kinds = ["Full_Time", "alternance", "CDD", "unknown", None]
    assert values(spark, kinds, roles.normalise_employment) == ["FULL_TIME", "APPRENTICESHIP", "TEMPORARY", None, None]


def test_urls(spark):
    raw = [
        "http://www.Example.com/jobs/1/?utm_source=x&b=2&a=1#apply",
        "https://example.com/jobs/1?a=1&b=2",
        "https://example.com:443/",
        "https://example.com/p?q=a%20b",
        "  plain  ",
    ]
    assert values(spark, raw, urls.normalise_url) == [
        "https://example.com/jobs/1?a=1&b=2", "https://example.com/jobs/1?a=1&b=2", "https://example.com/",
        "https://example.com/p?q=a+b", "plain",
    ]
    hosts = ["https://boards.example.io/x", "https://a.b.co.uk", "10.0.0.1", "localhost", "https://jobs.lever.co./"]
    assert values(spark, hosts, urls.registrable_domain) == ["example.io", "b.co.uk", "10.0.0.1", "localhost", "lever.co"]


def test_text(spark):
    raw = ["&amp;lt; &#233;&#xe9; &nope; &EACUTE;", "a & b", "&#1114112;"]
    assert values(spark, raw, text.decode_entities) == ["&lt; éé &nope; é", "a & b", "&#1114112;"]
    assert values(spark, ["<p>A</p><p>B<br/>C</p><style>x</style>"], text.strip_html) == ["A\nB\nC"]
    assert values(spark, ["Été à Paris!", "日本語"], text.fold_key) == ["ete a paris", ""]


def test_safe_markup(spark):
    raw = [
        '<div onclick="x">Hi<script>bad()</script></div>',
        "<ul><li>a<li>b</ul>",
        '<a href="javascript:alert(1)">x</a><a href=\'https://e.com/?a=1&b="2"\'>y</a>',
        "<p>a<p>b",
        None,
    ]
    assert values(spark, raw, sanitize_html) == [
        "Hi", "<ul><li>a</li><li>b</li></ul>",
        '<a>x</a><a href="https://e.com/?a=1&amp;b=&quot;2&quot;" target="_blank" rel="noopener noreferrer nofollow">y</a>',
        "<p>a</p><p>b</p>", None,
    ]


def test_places(spark):
    raw = ["Remote (US)", "Paris, London", "Montréal, QC", "Worldwide", "Hybrid – Remote Berlin", "Lyon et Paris"]
    df = with_places(spark.createDataFrame([(i, [v]) for i, v in enumerate(raw)], "i int, v array<string>"), F.col("v"))
    got = [[(p.city, p.region, p.country, p.remote) for p in r.places] for r in df.orderBy("i").collect()]
    assert got == [
        [(None, None, "US", "REMOTE")],
        [("Paris", None, "FR", None), ("London", None, "GB", None)],
        [("Montréal", "QC", "CA", None)],
        [],
        [("Berlin", None, "DE", "HYBRID")],
        [("Lyon", None, "FR", None), ("Paris", None, "FR", None)],
    ]


def test_cv(spark):
    cv = "\n".join(
        [
            "Jane Doe", "Lyon, France", "jane@doe.fr", "Expériences professionnelles", "Développeuse Backend – Acme, Paris", "2019 - 2023",
            "Data Engineer chez Beta", "2017 - 2019", "Formation", "Master Informatique", "Compétences", "Python, Kubernetes, Go",
        ]
    )
    as_of = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    row = rs.extract_profiles(spark.createDataFrame([(1, cv)], "user_id int, text string"), as_of).first()
    assert row.titles == ["Développeuse Backend", "Data Engineer"]
    assert row.domains == ["BACKEND", "DATA"]
    assert row.years_of_experience == 6
    assert row.seniorities == ["SENIOR", "LEAD"]
    assert "FR" in row.countries and "Lyon" in row.cities
    assert row.keywords == ["python", "go", "kubernetes"]
