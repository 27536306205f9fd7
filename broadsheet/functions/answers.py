"""Prompts for, and answers of, the model behind an enricher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENRICH_ANSWER, SCORE_ANSWER, SUMMARY_ANSWER
from .text import clamp, normal_tags, repaired_json

MAX_EXAMPLES = 8


def examples_block(examples: list[tuple[int, str]]) -> str:
    """Verdicts (1 or -1) with titles, at most eight."""
    if not examples:
        return ""
    lines = [f"- {'liked' if verdict > 0 else 'disliked'}: {title.strip()}" for verdict, title in examples[:MAX_EXAMPLES]]
    return "\n\nEarlier verdicts of this reader:\n" + "\n".join(lines)


def system_prompt(profile: str, examples: list[tuple[int, str]], rescore: bool = False) -> str:
    """Without a profile nothing asks for a score; a rescore asks for nothing else."""
    profile = profile.strip()
    ask = "Answer in JSON."
    summary = ' Give "summary", two plain sentences, and "tags", up to four lower-case topics.'
    score = ' Give "score", 0 to 100 for how well it meets the interests, and "reason", one short sentence.'
    if not profile:
        return ask + summary
    return f"{ask}{'' if rescore else summary}{score}\n\nInterests:\n{profile}{examples_block(examples)}"


def digest_system(profile: str, day: str) -> str:
    interests = f"\n\nInterests:\n{profile.strip()}" if profile.strip() else ""
    return f'Write the digest of {day} in JSON: "intro", one sentence, and up to six "threads", each with "title", "note" and the "item_ids" it speaks of.{interests}'


def digest_user(candidates: DataFrame) -> DataFrame:
    """One prompt of a day's candidates (at most 40 rows), best first."""
    line = F.concat(
        F.lit("\n["), F.col("id").cast("string"), F.lit("] "), F.trim("title"), F.lit(" — "), F.trim("feed_title"),
        F.when(F.col("score").isNotNull(), F.concat(F.lit(" (score "), F.col("score").cast("string"), F.lit(")"))).otherwise(""),
        F.when(F.col("summary").isNotNull(), F.concat(F.lit("\n    "), F.trim("summary"))).otherwise(""),
    )
    rank = F.struct((-F.coalesce("score", F.lit(-1))).alias("s"), (-F.unix_seconds(F.col("recency").cast("timestamp"))).alias("r"), (-F.col("id")).alias("i"), line.alias("line"))
    return candidates.agg(F.concat(F.lit("Items:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["line"]), "")).alias("prompt"))


def read_answer(answer: Column, kind: str = "enrich") -> Column:
    """A model's answer as a struct, repaired where it can be, null where not; scores within 0 to 100, tags normal."""
    schema = {"enrich": ENRICH_ANSWER, "score": SCORE_ANSWER, "summary": SUMMARY_ANSWER}[kind]
    read = F.from_json(repaired_json(answer), schema)
    fields = []
    if kind != "score":
        fields += [read["summary"].alias("summary"), normal_tags(read["tags"]).alias("tags")]
    if kind != "summary":
        fields += [clamp(read["score"], 0, 100).alias("score"), read["reason"].alias("reason")]
    return F.when(read["score" if kind == "score" else "summary"].isNotNull(), F.struct(*fields))
