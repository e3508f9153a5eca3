"""Turn-level metrics and model comparison (M1-M12, J8-J10, RW1-RW7). Definitions marked M follow published descriptions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import stats
from turnmill.functions import text as T


def eos_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """rows (is_eos, predicted): recall on ending rows, false-positive rate on the others."""
    empty = (F.trim("predicted") == "").cast("double")
    return rows.groupBy(*by).agg(F.count_if("is_eos").alias("n_eos"), T.rounded(F.coalesce(F.avg(F.when(F.col("is_eos"), empty)), F.lit(0.0)), 4).alias("eos_recall"), T.rounded(F.coalesce(F.avg(F.when(~F.col("is_eos"), empty)), F.lit(0.0)), 4).alias("eos_false_positive"))


def entity_prf(pred: Column, ref: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two entity arrays as sets; both empty is 1."""
    p, r, both = F.size(F.array_distinct(pred)), F.size(F.array_distinct(ref)), F.size(F.array_intersect(pred, ref)).cast("double")
    none = (p == 0) & (r == 0)
    precision = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(both, p), F.lit(0.0)))
    recall = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(both, r), F.lit(0.0)))
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def bleu(pred: Column, ref: Column, order: int = 2) -> Column:
    """Sentence score: brevity penalty times the geometric mean of clipped n-gram precisions with add-one smoothing above one word."""
    def of(p: Column, r: Column) -> Column:
        def precision(n: int) -> Column:
            add = 0.0 if n == 1 else 1.0

            def clipped(a: Column, b: Column) -> Column:
                count = lambda g: F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g)))
                found = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, g: s + count(g)) + F.lit(add)
                return F.ln(F.when(found > 0, F.try_divide(found, F.size(a) + F.lit(add))))

            return T.let(T.ngrams(p, n), lambda a: T.let(T.ngrams(r, n), lambda b: clipped(a, b)))

        total = sum((precision(n) for n in range(1, order + 1)), F.lit(0.0)) / order
        brevity = F.least(F.lit(0.0), 1 - F.try_divide(F.size(r).cast("double"), F.size(p)))
        return F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0).otherwise(F.coalesce(F.exp(total + brevity), F.lit(0.0)))

    return T.let(T.words(F.lower(pred)), lambda p: T.let(T.words(F.lower(ref)), lambda r: of(p, r)))


def style_compliant(style: Column, n: Column, hedges: Column, kind: Column) -> Column:
    """null for type_b, where style is not judged."""
    ok = F.when(style == "terse", n <= 12).when(style == "direct", n <= 20).when(style == "indirect", (n >= 8) & (hedges > 0)).otherwise(True)
    return F.when(kind != "type_b", ok)


def pairwise(rows: DataFrame, model: str, example: str, value: str) -> DataFrame:
    """One row per pair of models a < b on shared examples: wins, ties, means, Wilcoxon. Models are few; examples meet by equality."""
    a = rows.select(F.col(example).alias("e"), F.col(model).alias("model_a"), F.col(value).alias("va"))
    b = rows.select(F.col(example).alias("e"), F.col(model).alias("model_b"), F.col(value).alias("vb"))
    both = a.join(b, "e").where("model_a < model_b")
    by = ["model_a", "model_b"]
    counts = both.groupBy(*by).agg(F.count("*").alias("n_examples"), F.count_if(F.col("va") > F.col("vb")).alias("a_wins"), F.count_if(F.col("va") < F.col("vb")).alias("b_wins"), F.count_if(F.col("va") == F.col("vb")).alias("ties"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"))
    rate = lambda c: T.rounded(F.col(c).cast("double") / F.col("n_examples"), 4).alias(c.replace("wins", "win_rate").replace("ties", "tie_rate"))
    tested = counts.join(stats.wilcoxon(both, by, "va", "vb"), by, "left")
    return tested.select(*by, "n_examples", rate("a_wins"), rate("b_wins"), rate("ties"), "a_wins", "b_wins", "ties", T.rounded(F.col("ma"), 4).alias("mean_a"), T.rounded(F.col("mb"), 4).alias("mean_b"), F.coalesce("wilcoxon_stat", F.lit(0.0)).alias("wilcoxon_stat"), F.coalesce("p_value", F.lit(1.0)).alias("p_value")).withColumn("significant", F.col("p_value") < 0.05)


def order_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of adapted models first."""
    both = F.col("model_a").startswith("lora_") & F.col("model_b").startswith("lora_")
    return pairs.orderBy(F.when(both, 0).otherwise(1), "model_a", "model_b")


def side_by_side(rows: DataFrame, size: str, example: str, role: str, value: str, roles: tuple[str, str] = ("base", "lora")) -> DataFrame:
    """(size, example, value per role): full outer by pivot."""
    return rows.groupBy(size, example).agg(*[F.max(F.when(F.col(role) == r, F.col(value))).alias(f"{r}_{value}") for r in roles])


def size_delta(by_variant: DataFrame, value: str) -> DataFrame:
    """base against adapted per size."""
    cut = by_variant.select(F.substring_index("model_variant", "_", 1).alias("kind"), F.get(F.split("model_variant", "_", 2), F.lit(1)).alias("model_size"), F.col(value).alias("v"))
    base, adapted = cut.where("kind = 'base'").select("model_size", F.col("v").alias("base")), cut.where("kind = 'lora'").select("model_size", F.col("v").alias("lora"))
    return base.join(adapted, "model_size").withColumn("delta", T.rounded(F.col("lora") - F.col("base"), 3))


def rule_reward(completion: Column, n_tokens: Column, eos: str = "<eos>", least: int = 20, most: int = 200) -> Column:
    ended = F.when(F.contains(completion, F.lit(eos)) | F.contains(completion, F.lit("<eos>")), 0.4).otherwise(0.0)
    length = F.when(n_tokens.between(least, most), 0.4).when(n_tokens < least, 0.1).otherwise(0.0)
    ratio = T.trigram_ratio(completion)
    return ended + length + F.when(ratio >= 0.8, 0.2).when(ratio >= 0.5, 0.1).otherwise(0.0)


def judge_reward(dims: list[str], most: float = 14.0, failed: str | None = None) -> Column:
    """Sum of the dimensions over `most`; 0 where the call failed, as told by the column `failed`."""
    total = sum((F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in dims), F.lit(0.0)) / most
    return F.when(F.col(failed), 0.0).otherwise(total) if failed else total


def composite_reward(judge: Column, rule: Column, weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    return weights[0] * judge + weights[1] * rule
