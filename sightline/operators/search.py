"""Evolutionary search for a calibration, all videos in one plan per generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.projective import H_COLUMNS
from ..settings import SEARCH, SearchDefaults
from .calibration import score_candidates
from .support import cut_lineage

_KEYS = ("video_id", "cand_id")


def _range_of(name: str, s: SearchDefaults) -> tuple[float, float]:
    if name in ("h02", "h12"):
        return s.offset_range
    return s.perspective_range if name in ("h20", "h21") else s.main_range


def _bounds(s: SearchDefaults) -> tuple[Column, Column]:
    ranges = [_range_of(c, s) for c in H_COLUMNS]
    low, high = (F.array(*[F.lit(float(r[i])) for r in ranges]) for i in (0, 1))
    return low, high


def _mutated(
    values: Column, rate: float, amount: float, seed: int, s: SearchDefaults, *parts
) -> Column:
    """Each of the eight parameters shifted at random with probability ``rate``, within bounds."""
    low, high = _bounds(s)

    def shifted(value, i):
        size = F.get(high, i) - F.get(low, i)
        moved = value + draws.gaussian(seed, *parts, i, "shift") * F.lit(amount) * size
        moved = F.greatest(F.get(low, i), F.least(F.get(high, i), moved))
        return F.when(draws.uniform(seed, *parts, i, "mutate") < rate, moved).otherwise(value)

    return F.transform(values, shifted)


def _params() -> Column:
    return F.array(*[F.col(c) for c in H_COLUMNS])


def _as_columns(values: Column) -> list[Column]:
    return [F.get(values, F.lit(i)).alias(c) for i, c in enumerate(H_COLUMNS)]


def _members(s: SearchDefaults) -> Column:
    last = F.lit(s.population - 1).cast("bigint")
    return F.explode(F.sequence(F.lit(0).cast("bigint"), last))


def seed_population(
    seeds: DataFrame, seed: int = 0, settings: SearchDefaults = SEARCH
) -> DataFrame:
    """Generation 0: each video's own calibration and strongly mutated copies of it."""
    d = seeds.select("video_id", _params().alias("p"), _members(settings).alias("cand_id"))
    parts = (F.col("video_id"), F.lit(0), F.col("cand_id"))
    varied = _mutated(F.col("p"), settings.seed_mutation_rate, settings.seed_mutation_amount,
                      seed, settings, *parts)
    d = d.withColumn("p", F.when(F.col("cand_id") == 0, F.col("p")).otherwise(varied))
    return d.select(*_KEYS, *_as_columns(F.col("p")))


def _tournament(seed: int, s: SearchDefaults, *parts) -> Column:
    """Best rank (0 = fittest) among three different members drawn at random."""
    n = s.population

    def draw(k):
        return F.floor(draws.uniform(seed, *parts, k) * F.lit(n - k)).cast("int")

    first, second, third = draw(0), draw(1), draw(2)
    second = F.when(second >= first, second + 1).otherwise(second)
    low, high = F.least(first, second), F.greatest(first, second)
    third = F.when(third >= low, third + 1).otherwise(third)
    third = F.when(third >= high, third + 1).otherwise(third)
    return F.least(low, third)


def next_generation(
    scored: DataFrame, generation: int, seed: int = 0, settings: SearchDefaults = SEARCH
) -> DataFrame:
    """Elites unchanged, then children by tournament, uniform crossover and mutation.

    Each video's population is one array of fixed length, so breeding needs no
    join and no more than one row per video.
    """
    if settings.tournament != 3 or settings.population < 3:
        raise ValueError("the tournament draws three members")
    member = F.struct((-F.col("fitness")).alias("f"), "cand_id", _params().alias("p"))
    parents = scored.groupBy("video_id").agg(F.sort_array(F.collect_list(member)).alias("pop"))
    d = parents.select("video_id", "pop", _members(settings).alias("cand_id"))
    parts = (F.col("video_id"), F.lit(generation), F.col("cand_id"))
    mother = F.get("pop", _tournament(seed, settings, *parts, "mother"))["p"]
    father = F.get("pop", _tournament(seed, settings, *parts, "father"))["p"]
    cross = draws.uniform(seed, *parts, "cross") <= settings.crossover_rate
    d = d.withColumns({"mother": mother, "father": father, "cross": cross})

    def mixed(value, i):
        swap = F.col("cross") & (draws.uniform(seed, *parts, i, "swap") >= 0.5)
        return F.when(swap, F.get("father", i)).otherwise(value)

    child = _mutated(F.transform("mother", mixed), settings.mutation_rate,
                     settings.mutation_amount, seed, settings, *parts)
    elite = F.get("pop", F.col("cand_id").cast("int"))["p"]
    d = d.withColumn("p", F.when(F.col("cand_id") < settings.elites, elite).otherwise(child))
    return d.select(*_KEYS, *_as_columns(F.col("p")))


def search_homographies(
    seeds: DataFrame, lines: DataFrame, generations: int | None = None, seed: int = 0,
    frame: tuple[int, int] = (1920, 1080), settings: SearchDefaults = SEARCH,
    keep_history: bool = False,
) -> DataFrame:
    """Evolve each video's calibration until its best reaches the goal, or ``generations`` have passed.

    A video stops after the first generation whose best fitness is at least
    ``settings.fitness_goal``; it is neither bred nor scored again, so later rounds shrink. The
    default of ``generations`` is ``settings.max_generations``. Returns the last scored population
    of each video with its ``generation``, or with ``keep_history`` all of them.

    Every random number is drawn from a hash of (seed, video, generation, candidate, parameter),
    so a rerun or a lost task gives the same search, and no video's search depends on another's.
    """
    lines = cut_lineage(lines.select("video_id", "x1", "y1", "x2", "y2", "confidence"))
    last = settings.max_generations if generations is None else generations

    def score(population, generation, active_lines):
        scored = score_candidates(population, active_lines, frame)
        # Scoring reads the population twice; cutting here keeps each plan one generation long.
        return cut_lineage(scored.withColumn("generation", F.lit(generation).cast("bigint")))

    current = score(seed_population(seeds, seed, settings), 0, lines)
    history, stopped = [current], []
    for g in range(1, last + 1):
        best = current.groupBy("video_id").agg(F.max("fitness").alias("best"))
        best = cut_lineage(best.withColumn("done", F.coalesce(F.col("best") >= settings.fitness_goal, F.lit(False))))
        counts = best.groupBy("done").count().collect()  # two rows at most
        if any(r["done"] for r in counts):
            stopped.append(current.join(best.where("done"), "video_id", "left_semi"))
            active = best.where("NOT done").select("video_id")
            current = current.join(active, "video_id", "left_semi")
            lines = lines.join(active, "video_id", "left_semi")
        if not any(not r["done"] for r in counts):
            break
        current = score(next_generation(current, g, seed, settings), g, lines)
        history.append(current)
    else:
        stopped.append(current)
    out, *others = history if keep_history else stopped
    for part in others:
        out = out.unionByName(part)
    return out
