"""Cheaper searches find what the patterns as written find."""

import re

from pyspark.sql import functions as F

from hirelake.functions import roles, text
from hirelake.operators import resume
from hirelake.plans import q_profiles
from hirelake.plans.domain import Domain

TEXTS = [
    None, "", "Senior Backend Engineer", "DÉVELOPPEUR confirmé", "infraé", "équipe devops", "ſre", "x sreK", "İOS engineer",
    "data analyst", "team  manager", "full-stack\tdev", "chef de produit", "tudiant", "Étudiant m1", "lycée", "master’s",
    "😀ux", "ux😀", "alternanſ", "Télétravail total", "r\x01 sr. ", "présentiel", "À distance", "100% remote", "ẛre", "sign in", "mission\n", "fp&a",
]


def test_plain_forms_find_what_words_find(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    lists = (roles.DOMAIN_PATTERNS, roles.SENIORITY_PATTERNS, roles.EMPLOYMENT_PATTERNS, resume.CONTRACT_PATTERNS)
    patterns = [p for found in lists for p, _ in found] + [resume.STUDENT, resume.SCHOOL, resume.LOCATION_HINT, roles.REMOTE_WORDS, roles.ON_SITE_PATTERN]
    columns = [F.col("t").rlike(text.words(p)).eqNullSafe(text.matches(F.col("t"), p)).alias(f"c{i}") for i, p in enumerate(patterns)]
    for row in rows.select("t", *columns).collect():
        wrong = [p for i, p in enumerate(patterns) if not row[f"c{i}"]]
        assert not wrong, (row.t, wrong)


def test_entities_in_one_pass(spark):
    texts = ["&amp;lt;", "&amp;amp; &LT;b&gt;", "&#38;quot;", "&lt;&unknown;&eacute;x&Nbsp;", "a & b", None, "&&amp;;", "&#38;#38;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(text.decode_entities(F.col("t"))).collect()]
    assert found == ["&lt;", "&amp; <b>", '"', "<&unknown;éx ", "a & b", None, "&&;", "&#38;"]


def test_edges_are_trimmed_without_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in ["  a b\t　", "﻿", "", None, "– a – b,| "]], "t string")
    found = rows.select(text.trim_ws(F.col("t")).alias("t"), text.trim_edges(F.col("t")).alias("e")).collect()
    assert [tuple(r) for r in found] == [("a b", "a b"), ("", ""), ("", ""), (None, None), ("– a – b,|", "a – b")]


def test_keywords_of_a_missing_text_are_none(spark):
    rows = spark.createDataFrame([(None,), ("Go, C++ and next.js; rest",)], "t string")
    assert [r[0] for r in rows.select(resume.extract_keywords(F.col("t"))).collect()] == [[], ["go", "c++", "next.js", "rest"]]


def test_one_file_of_customers_is_many_tasks(spark, tmp_path):
    spark.createDataFrame([(i, f"Name {i}") for i in range(50)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    tasks = q_profiles.cvs(Domain(spark, str(tmp_path)))._jdf.queryExecution().toString()
    assert re.search(r"RoundRobinPartitioning\(%s\)" % spark.conf.get("spark.sql.shuffle.partitions"), tasks)
