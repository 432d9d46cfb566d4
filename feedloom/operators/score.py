"""The explainable 0-100 score.  Everything is one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_days
from ..functions.labels import lookup
from ..functions.text import contained, let, literals, text_or_empty, word_hits
from ..rules import HARD_DISQUALIFIERS, SPONSORSHIP_FACTORS, RulePack
from .classify import has_new_grad_marker


def points(share: Column, weight: int) -> Column:
    """Share of a weight, rounded half to even."""
    return F.rint(share * F.lit(weight)).cast("int")


def _note(label: str, pts: Column, weight: int, *inside: Column | str) -> Column:
    body = [F.lit(x) if isinstance(x, str) else x for x in inside]
    return F.concat(F.lit(f"{label} "), pts.cast("string"), F.lit(f"/{weight} ("), *body, F.lit(")"))


def _cased(hits_lower: Column, terms: list[str]) -> Column:
    """Configured spelling of a lower-cased hit."""
    return lookup(hits_lower, {t.lower(): t for t in terms}, hits_lower)


def role_match(title: Column, matched: Column, text: Column, pack: RulePack) -> Column:
    """struct(score, skills, primary, secondary): role and skill sub-score, 0-100."""
    skills = [s.lower() for s in pack.skills]

    def combine(h: Column) -> Column:
        base = (
            F.when((F.size(h["primary"]) == 0) & (F.size(h["secondary"]) > 0), F.lit(45))
            .when((F.size(h["primary"]) > 0) | (F.size(h["matched"]) > 0), F.lit(60))
            .otherwise(F.lit(0))
        )
        total = F.least(F.lit(100), base + F.least(F.lit(40), F.size(h["skills"]) * 5))
        return F.struct(
            total.alias("score"),
            h["skills"].alias("skills"),
            F.get(h["primary"], F.lit(0)).alias("primary"),
            F.get(h["secondary"], F.lit(0)).alias("secondary"),
        )

    found = F.struct(
        let(F.lower(title), lambda low: contained(low, [r.lower() for r in pack.primary_roles])).alias("primary"),
        let(F.lower(title), lambda low: contained(low, [r.lower() for r in pack.secondary_roles])).alias("secondary"),
        word_hits(text, skills).alias("skills"),
        matched.alias("matched"),
    )
    return let(found, combine)


def matched_keywords(matched: Column, skills: Column) -> Column:
    return F.array_sort(F.array_union(matched, skills))


def graduation_share(match: Column, matched: Column, pack: RulePack) -> Column:
    return (
        F.when(match == "compatible_2027", F.lit(1.0))
        .when(match == "compatible_2026", F.lit(0.9))
        .when(F.startswith(match, F.lit("incompatible")), F.lit(0.0))
        .when(F.startswith(match, F.lit("future")), F.lit(0.5))
        .when(has_new_grad_marker(matched, pack), F.lit(0.6))
        .otherwise(F.lit(0.4))
    )


def sponsorship_share(classification: Column) -> Column:
    return lookup(classification, SPONSORSHIP_FACTORS, F.lit(0.45))


def recency_share(age: Column, pack: RulePack) -> Column:
    full, zero = pack.recency_full_days, pack.recency_zero_days
    return (
        F.when(age.isNull(), F.lit(0.5))
        .when(age <= full, F.lit(1.0))
        .when(age >= zero, F.lit(0.0))
        .otherwise(F.lit(1.0) - (age - full) / F.lit(float(zero - full)))
    )


def location_known(location: Column, country: Column) -> Column:
    return F.startswith(F.lower(text_or_empty(country)), F.lit("united states")) | (
        text_or_empty(location) != ""
    )


def with_score(df: DataFrame, pack: RulePack, run_ts: Column) -> DataFrame:
    """Scores a gated and classified frame (it carries `decision`).

    Sets the sub-score, the total, its explanation, the matched keywords and
    the disqualification.  `run_ts` is an argument, never the clock.
    """
    w = pack.weights
    text = F.concat_ws(" ", "title", "description", "requirements")
    matched = F.col("decision.matched")
    scored = df.withColumns(
        {
            "_role": role_match(F.col("title"), matched, text, pack),
            "_age": age_days(F.col("date_posted"), run_ts),
            "_grad": points(graduation_share(F.col("graduation_match"), matched, pack), w["graduation"]),
            "_sponsor": points(
                sponsorship_share(F.col("sponsorship_classification")), w["sponsorship"]
            ),
            "_known": location_known(F.col("location"), F.col("country")),
        }
    ).withColumns(
        {
            "_pts_role": points(F.col("_role.score") / F.lit(100), w["role_skills"]),
            "_loc": F.when(F.col("_known"), F.lit(w["location"])).otherwise(
                points(F.lit(0.5), w["location"])
            ),
            "_recency": points(recency_share(F.col("_age"), pack), w["recency"]),
        }
    )
    skills = F.col("_role.skills")
    primary, secondary = F.col("_role.primary"), F.col("_role.secondary")
    role_note = (
        F.when(
            primary.isNotNull(),
            F.concat(F.lit("primary role match ("), _cased(primary, pack.primary_roles), F.lit(")")),
        )
        .when(
            secondary.isNotNull(),
            F.concat(
                F.lit("secondary role match ("), _cased(secondary, pack.secondary_roles), F.lit(")")
            ),
        )
        .when(F.size(matched) > 0, F.lit("title matched filter terms"))
        .otherwise(F.lit("no role-family match"))
    )
    skill_note = F.when(
        F.size(skills) > 0,
        F.concat(F.lit("; skills: "), F.array_join(F.slice(skills, 1, 6), ", ")),
    ).otherwise(F.lit(""))
    place = F.when(
        F.col("_known"), F.left(F.when(F.col("location") != "", F.col("location")).otherwise(F.col("country")), F.lit(40))
    ).otherwise(F.lit("location unknown"))
    age_note = F.when(F.col("_age").isNull(), F.lit("posting date unknown")).otherwise(
        F.concat(F.lit("posted "), F.col("_age").cast("string"), F.lit("d ago"))
    )
    explanation = [
        _note("role", F.col("_pts_role"), w["role_skills"], role_note, skill_note),
        _note("graduation", F.col("_grad"), w["graduation"], F.col("graduation_match")),
        _note("sponsorship", F.col("_sponsor"), w["sponsorship"], F.col("sponsorship_classification")),
        _note("location", F.col("_loc"), w["location"], place),
        _note("recency", F.col("_recency"), w["recency"], age_note),
    ]
    if "graduation_note" in df.columns:
        explanation.append(F.concat(F.lit("graduation note: "), F.col("graduation_note")))
    return (
        scored.withColumns(
            {
                "role_match_score": F.col("_role.score"),
                "matched_keywords": matched_keywords(matched, skills),
                "overall_score": F.col("_pts_role")
                + F.col("_grad") + F.col("_sponsor") + F.col("_loc") + F.col("_recency"),
                "score_explanation": F.concat_ws(" · ", *explanation),
                **disqualification(),
            }
        )
        .drop("_role", "_age", "_grad", "_sponsor", "_known", "_pts_role", "_loc", "_recency")
    )


def disqualification() -> dict[str, Column]:
    """Columns `disqualified` and `disqualify_reason` of a classified frame."""
    cls, found = F.col("sponsorship_classification"), F.col("sponsorship_evidence")
    hard = F.array_contains(literals(HARD_DISQUALIFIERS), cls)
    wrong_year = F.startswith(F.col("graduation_match"), F.lit("incompatible"))
    reason = (
        F.when(
            hard,
            F.concat(
                F.lit("sponsorship classification '"), cls, F.lit("'"),
                F.when(found != "", F.concat(F.lit(": "), F.left(found, F.lit(160)))).otherwise(F.lit("")),
            ),
        )
        .when(wrong_year, F.concat(F.lit("graduation mismatch ("), F.col("graduation_match"), F.lit(")")))
        .otherwise(F.lit(""))
    )
    return {"disqualified": hard | wrong_year, "disqualify_reason": reason}
