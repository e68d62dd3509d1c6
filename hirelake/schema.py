"""Table schemas, enums and other fixed values of the job-market model.

Names are snake_case; keys are typed by the caller's tables (the operators only
compare them). Times are naive UTC (`timestamp_ntz`).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enum members -------------------------------------------------

WORK_DOMAINS = [
    "BACKEND", "FRONTEND", "FULLSTACK", "MOBILE", "DATA", "MACHINE_LEARNING", "INFRASTRUCTURE",
    "SECURITY", "EMBEDDED", "QA", "RESEARCH", "PRODUCT", "DESIGN", "DEVREL", "SALES", "MARKETING",
    "FINANCE", "OPERATIONS", "OTHER",
]
SENIORITY_LEVELS = ["INTERN", "JUNIOR", "MID", "SENIOR", "LEAD", "MANAGER", "DIRECTOR"]
EMPLOYMENT_TYPES = [
    "FULL_TIME", "PART_TIME", "CONTRACT", "TEMPORARY", "INTERNSHIP", "APPRENTICESHIP", "FREELANCE",
    "VOLUNTEER", "OTHER",
]
REMOTE_TYPES = ["ON_SITE", "HYBRID", "REMOTE"]
POSTING_STATUSES = ["NEW", "SEEN", "DISMISSED", "APPLIED"]
APPLICATION_STATUSES = [
    "WISHLIST", "APPLIED", "INTERVIEW", "OFFER", "REJECTED", "GHOSTED", "NOT_ELIGIBLE",
]
APPLICATION_TIERS = ["S_TIER", "A_TIER", "B_TIER", "NONE"]
COMPANY_STATUSES = ["PENDING", "APPROVED", "REJECTED"]
CLOSED_REASONS = ["REMOVED_FROM_LISTING", "DEAD_LINK", "MARKED_CLOSED", "EXPIRED"]
FILE_KINDS = ["RESUME", "COVER_LETTER", "DIPLOMA", "CERTIFICATE"]
COMPANY_INDUSTRIES = [
    "ADVERTISING", "AEROSPACE", "AGRICULTURE", "AI", "AIRLINES", "ART", "AUTOMOTIVE", "BANKING",
    "BIOTECHNOLOGY", "BLOCKCHAIN", "CHEMICALS", "CLOUD_COMPUTING", "CONSUMER_GOODS",
    "CYBERSECURITY", "EDUCATION", "ENERGY", "ENTERTAINMENT", "FASHION", "FINANCE",
    "FOOD_AND_BEVERAGE", "GAMING", "GOVERNMENT", "HEALTHCARE", "HOSPITALITY", "INSURANCE",
    "INTERNET", "LEGAL", "LOGISTICS", "MANUFACTURING", "MEDIA", "MINING", "NON_PROFIT",
    "PHARMACEUTICALS", "REAL_ESTATE", "RETAIL", "ROBOTICS", "SEMICONDUCTORS", "SOFTWARE", "SPACE",
    "SPORTS", "TELECOMMUNICATIONS", "TRANSPORTATION", "TRAVEL",
]
EVENT_TYPES = [
    "POSTING_VIEWED", "POSTING_SAVED", "POSTING_UNSAVED", "POSTING_DISMISSED",
    "APPLICATION_CREATED", "APPLICATION_SENT", "FOLLOW_UP_SENT", "INTERVIEW_SCHEDULED",
    "OFFER_RECEIVED", "REJECTION_RECEIVED", "MARKED_GHOSTED",
]
USER_RECORDABLE_EVENTS = [
    "FOLLOW_UP_SENT", "INTERVIEW_SCHEDULED", "OFFER_RECEIVED", "REJECTION_RECEIVED",
    "MARKED_GHOSTED",
]
MATCH_CRITERIA = [
    "DOMAIN", "SENIORITY", "EMPLOYMENT_TYPE", "LOCATION", "REMOTE_TYPE", "TITLE", "KEYWORDS",
    "MOTIVATION", "RESUME", "INDUSTRY", "SALARY", "FRESHNESS",
]
IMPORTANCE = {"IGNORED": 0.0, "NICE_TO_HAVE": 0.5, "NORMAL": 1.0, "ESSENTIAL": 2.0}

# --- schemas --------------------------------------------------------------------

PLACE = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("remote", T.StringType()),
])

# One raw job as a board lists it; everything but title and url may be missing.
DISCOVERED_JOB = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("board_url", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("description_html", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("locations", T.ArrayType(T.StringType())),
    T.StructField("department", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("remote", T.BooleanType()),
    T.StructField("remote_type", T.StringType()),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("salary_currency", T.StringType()),
    T.StructField("posted_at", T.StringType()),
    T.StructField("valid_through", T.StringType()),
    T.StructField("partial", T.BooleanType()),
])

# The columns the content hash covers and the merge overwrites, in hash order.
CONTENT_COLUMNS = [
    "title", "external_id", "description", "description_html", "location", "department", "domain",
    "seniority", "employment_type", "remote_type", "salary_min", "salary_max", "salary_currency",
    "source", "posted_at", "valid_through",
]

POSTING_COLUMNS = {
    "id": "string", "company_id": "bigint", "title": "string", "url": "string",
    "external_id": "string", "description": "string", "description_html": "string",
    "location": "string", "dedup_key": "string", "content_hash": "string",
    "department": "string", "domain": "string", "seniority": "string",
    "employment_type": "string", "remote_type": "string", "salary_min": "int",
    "salary_max": "int", "salary_currency": "string", "source": "string",
    "posted_at": "timestamp_ntz", "valid_through": "timestamp_ntz",
    "last_seen_at": "timestamp_ntz", "closed_at": "timestamp_ntz", "closed_reason": "string",
    "detail_fetched_at": "timestamp_ntz", "last_validated_at": "timestamp_ntz",
    "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz",
}

PREFERENCE_ARRAYS = [
    "domains", "seniorities", "employment_types", "remote_types", "countries", "cities", "titles",
    "keywords", "required_keywords", "industries", "motivations", "resume_keywords",
    "excluded_keywords", "excluded_company_ids",
]
