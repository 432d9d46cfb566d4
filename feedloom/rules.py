"""Rule packs: term lists and numbers kept as data, compiled into expressions.

`POSTING` holds the terms of a job-posting monitor.  `CORPUS` has the same
shape with terms that occur in free multilingual prose, so every branch of every
rule is exercised on document corpora too.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Title terms of the posting pack, in order.
POSTING_LEVEL = [
    "new grad", "new graduate", "university graduate", "university grad", "graduate",
    "early career", "early in career", "entry level", "entry-level", "campus",
    "software engineer i", "engineer i", "engineer 1", "swe i",
    "associate software engineer", "associate engineer", "junior software engineer",
    "junior engineer", "2027", "2026",
]
POSTING_ROLE = [
    "software engineer", "software developer", "software development engineer", "sde",
    "backend engineer", "back-end engineer", "full stack", "full-stack", "fullstack",
    "platform engineer", "infrastructure engineer", "machine learning engineer",
    "ml engineer", "ai engineer", "artificial intelligence engineer", "data engineer",
    "data scientist", "applied scientist", "research engineer", "developer tools",
    "devops engineer", "cloud engineer", "site reliability engineer",
    "member of technical staff",
]
POSTING_EXCLUDE = [
    "senior", "sr", "staff", "principal", "lead", "manager", "director", "architect",
    "distinguished", "vice president", "vp", "head of", "fellow", "intern", "internship",
    "co-op", "coop", "apprentice", "postdoc", "contractor", "ii", "iii", "iv",
    "engineer 2", "engineer 3", "engineer 4", "swe 2", "swe 3",
]
# Sponsorship phrases of the posting pack, in order.
POSTING_POSITIVE = [
    "visa sponsorship available", "visa sponsorship is available",
    "immigration sponsorship available", "offers visa sponsorship",
    "offer visa sponsorship", "provides sponsorship", "provide visa sponsorship",
    "will sponsor", "h-1b sponsorship", "h1b sponsorship", "sponsorship considered",
    "open to sponsorship", "sponsorship may be available", "eligible for sponsorship",
    "international candidates welcome", "international students are welcome",
    "opt accepted", "opt candidates", "stem opt accepted", "stem opt eligible", "cpt/opt",
    "f-1 opt", "support work visa", "support visa", "support immigration",
    "immigration support", "relocation and immigration",
]
POSTING_WEAK_POSITIVE = ["sponsorship", "work visa"]
POSTING_NEGATIVE = [
    "no current or future sponsorship", "not offer sponsorship", "not provide sponsorship",
    "no visa sponsorship", "without sponsorship now or in the future", "will not sponsor",
    "unable to sponsor", "cannot sponsor", "not able to sponsor",
    "no immigration sponsorship", "sponsorship is not available",
    "sponsorship not available", "not open to opt", "not eligible for opt",
    "not eligible for h-1b", "unrestricted work authorization",
    "without the need for sponsorship", "without the need for visa sponsorship",
    "without sponsorship", "must not require sponsorship", "not require sponsorship",
    "not require visa sponsorship", "not require current or future sponsorship",
    "now or in the future",
]
POSTING_INELIGIBLE = [
    "u.s. citizen only", "us citizen only", "u.s. citizenship is required",
    "us citizenship is required", "u.s. citizenship required", "must be a u.s. citizen",
    "must be a us citizen", "permanent resident only", "citizen or permanent resident",
    "green card holder", "u.s. person required", "us persons only", "u.s. persons",
    "security clearance required", "active clearance", "active security clearance",
    "ability to obtain a security clearance", "ts/sci", "itar",
]
# Candidate profile of the posting pack, in order.
POSTING_PRIMARY_ROLES = [
    "Software Engineer", "Backend Engineer", "Full-Stack Engineer", "Platform Engineer",
    "Infrastructure Engineer", "Machine Learning Engineer", "AI Engineer", "Data Engineer",
    "Data Scientist", "Applied Scientist", "Research Engineer", "Developer Tools Engineer",
]
POSTING_SECONDARY_ROLES = ["DevOps Engineer", "Cloud Engineer", "Technical Program Engineer"]
POSTING_SKILLS = [
    "Python", "TypeScript", "JavaScript", "C#", "SQL", "backend", "API", "cloud", "Azure",
    "AWS", "LLM", "AI", "RAG", "retrieval-augmented", "evaluation", "data pipeline", "ETL",
    "automation", "distributed systems", "microservices", "Kubernetes", "machine learning",
]
# Markers of a new-graduate title term.
NEW_GRAD_MARKERS = [
    "grad", "entry", "early", "campus", "junior", "associate", "engineer i", "swe i",
]
# Share of the sponsorship weight per class.
SPONSORSHIP_FACTORS = {
    "likely_supported": 1.0,
    "possibly_supported": 0.7,
    "unclear": 0.45,
    "likely_not_supported": 0.0,
    "ineligible": 0.0,
}
# Classes that keep a record out of recommendations.
HARD_DISQUALIFIERS = ["ineligible", "likely_not_supported"]
# Title families, first match wins, ASCII word boundaries.
FAMILY_PATTERNS = [
    ("mlai", r"machine learning|\bml\b|\bai\b|applied scientist|artificial intelligence|deep learning|llm"),
    ("data", r"data engineer|data scientist|analytics engineer|data platform"),
    ("infra", r"infrastructure|platform|devops|site reliability|\bsre\b|cloud engineer|systems engineer"),
    ("research", r"research"),
    ("swe", r"software|backend|back-end|full[ -]?stack|fullstack|developer|\bswe\b|\bsde\b|engineer"),
]


@dataclass(frozen=True)
class RulePack:
    """Everything that steers gating, classification, scoring and the lifecycle."""

    include_level: list[str]
    include_role: list[str]
    exclude: list[str]
    positive: list[str]
    weak_positive: list[str]
    negative: list[str]
    ineligible: list[str]
    primary_roles: list[str]
    secondary_roles: list[str]
    skills: list[str]
    compatible_years: list[int] = field(default_factory=lambda: [2026, 2027])
    incompatible_years: list[int] = field(default_factory=lambda: [2024, 2025])
    new_grad_markers: list[str] = field(default_factory=lambda: list(NEW_GRAD_MARKERS))
    families: list[tuple[str, str]] = field(default_factory=lambda: list(FAMILY_PATTERNS))
    weights: dict[str, int] = field(
        default_factory=lambda: {
            "role_skills": 35, "graduation": 20, "sponsorship": 25, "location": 10, "recency": 10,
        }
    )
    thresholds: dict[str, int] = field(
        default_factory=lambda: {"excellent": 80, "strong": 65, "possible": 50}
    )
    digest_min_score: int = 65
    recency_full_days: int = 7
    recency_zero_days: int = 60
    archive_after_missing_runs: int = 3
    min_posted_date: str = "2026-06-01"
    default_country: str = "United States"

    def __post_init__(self) -> None:
        if sum(self.weights.values()) != 100:
            raise ValueError("score weights must sum to 100")
        if self.recency_zero_days <= self.recency_full_days:
            raise ValueError("recency_zero_days must exceed recency_full_days")

    def with_changes(self, **changes) -> RulePack:
        return replace(self, **changes)


POSTING = RulePack(
    include_level=POSTING_LEVEL,
    include_role=POSTING_ROLE,
    exclude=POSTING_EXCLUDE,
    positive=POSTING_POSITIVE,
    weak_positive=POSTING_WEAK_POSITIVE,
    negative=POSTING_NEGATIVE,
    ineligible=POSTING_INELIGIBLE,
    primary_roles=POSTING_PRIMARY_ROLES,
    secondary_roles=POSTING_SECONDARY_ROLES,
    skills=POSTING_SKILLS,
)

CORPUS = RulePack(
    include_level=["the", "que", "der", "of the", "laleenéelle", "un", "early"],
    include_role=["and", "to", "la", "von", "is", "des", "in the", "was", "el", "die"],
    exclude=["attion", "thanedble", "that", "###", "ea", "es", "und der"],
    positive=["the thon", "of the", "que la", "und der", "ble the", "de la", "onan", "ment."],
    weak_positive=["tion", "lich"],
    negative=["@mail", "+1 (", "&&&", " | ", "mit der"],
    ineligible=["licensed under", "token = \"", "apache license"],
    primary_roles=["the", "der ", "que"],
    secondary_roles=["thre", "ción", "ment"],
    skills=["with", "From", "this", "por", "dans", "mit", "for", "been", "apache", "v2.0",
            "Version 2.0", "token", "una", "ist", "avec"],
    new_grad_markers=["the", "early", "of"],
    families=[
        ("articles", r"\bthe\b|\bder\b|\bla\b"),
        ("joins", r"\band\b|\bund\b|\bet\b"),
        ("preps", r"\bof\b|\bto\b|\bde\b|von"),
        ("long", r"thon|erer|ción|ment"),
    ],
    thresholds={"excellent": 70, "strong": 60, "possible": 45},
    digest_min_score=60,
    min_posted_date="1995-06-01",
    default_country="NOWHERE",
)
