"""Evaluation: blinding, arenas, choice tasks, probes, standard errors, tokenizer fertility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveyard.functions.text import draw, has_number


def blind_pairs(answers: DataFrame, first: str, second: str, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``answers(qid, model, answer)`` -> pairs in drawn order without names, and the sealed key of who wrote answer 1."""
    a = answers.where(F.col("model") == first).select("qid", F.col("answer").alias("x"))
    b = answers.where(F.col("model") == second).select("qid", F.col("answer").alias("y"))
    both = a.join(b, "qid").withColumn("swap", draw(F.lit(seed), "qid") % 2 == 1)
    pairs = both.select("qid", F.when(F.col("swap"), F.col("y")).otherwise(F.col("x")).alias("ans_1"), F.when(F.col("swap"), F.col("x")).otherwise(F.col("y")).alias("ans_2"))
    return pairs, both.select("qid", F.when(F.col("swap"), F.lit(second)).otherwise(F.lit(first)).alias("model"))


def unseal(votes: DataFrame, key: DataFrame, categories: DataFrame, models: tuple[str, str]) -> DataFrame:
    """Wins by category, and overall where the category is null.  Vote 0 is a tie, 1 the key's model, 2 the other."""
    other = F.when(F.col("model") == models[0], F.lit(models[1])).otherwise(F.lit(models[0]))
    winner = F.when(F.col("vote") == 0, F.lit("tie")).when(F.col("vote") == 1, F.col("model")).otherwise(other)
    judged = votes.join(key, "qid").join(categories, "qid").select("category", winner.alias("winner"))
    return judged.rollup("category").agg(F.count_if(F.col("winner") == models[0]).alias("first"), F.count_if(F.col("winner") == models[1]).alias("second"), F.count_if(F.col("winner") == "tie").alias("ties"))


def matchups(answers: DataFrame) -> DataFrame:
    """All pairs of models on the prompts they share."""
    a, b = answers.select("qid", F.col("model").alias("model_a")), answers.select("qid", F.col("model").alias("model_b"))
    return a.join(b, "qid").where("model_a < model_b")


def arena(votes: DataFrame) -> DataFrame:
    """``votes(model_a, model_b, winner)``, winner ``a``, ``b``, ``tie`` or ``skip`` -> wins, ties, games and (wins + ties / 2) / games."""
    side = lambda m, w: F.struct(F.col(m).alias("model"), (F.col("winner") == w).alias("won"), (F.col("winner") == "tie").alias("tied"))
    each = votes.where("winner <> 'skip'").select(F.explode(F.array(side("model_a", "a"), side("model_b", "b"))).alias("s")).select("s.*")
    out = each.groupBy("model").agg(F.count_if("won").alias("wins"), F.count_if("tied").alias("ties"), F.count("*").alias("games"))
    return out.withColumn("score", (F.col("wins") + 0.5 * F.col("ties")) / F.col("games"))


def choice_accuracy(scores: DataFrame) -> DataFrame:
    """``scores(task, item, choice, loglik, n_chars, gold)`` -> accuracy of the likeliest choice and of the likeliest per character, and their standard errors."""
    best = scores.groupBy("task", "item", "gold").agg(F.max_by("choice", F.struct("loglik", -F.col("choice"))).alias("by_sum"), F.max_by("choice", F.struct(F.col("loglik") / F.col("n_chars"), -F.col("choice"))).alias("by_mean"))
    right = best.select("task", (F.col("by_sum") == F.col("gold")).cast("double").alias("s"), (F.col("by_mean") == F.col("gold")).cast("double").alias("m"))
    se = lambda c: F.coalesce(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))
    return right.groupBy("task").agg(F.avg("s").alias("acc"), se("s").alias("acc_stderr"), F.avg("m").alias("acc_norm"), se("m").alias("acc_norm_stderr"))


def suite_average(results: DataFrame) -> DataFrame:
    """``results(model, task, acc, stderr)`` -> mean accuracy and its standard error over tasks."""
    return results.groupBy("model").agg(F.avg("acc").alias("average"), (F.sqrt(F.sum(F.col("stderr") * F.col("stderr"))) / F.count("*")).alias("se"))


def z_score(averages: DataFrame, a: str, b: str) -> DataFrame:
    """(mean a - mean b) / sqrt(se a squared + se b squared)."""
    x = averages.where(F.col("model") == a).select(F.col("average").alias("xa"), F.col("se").alias("xs"))
    y = averages.where(F.col("model") == b).select(F.col("average").alias("ya"), F.col("se").alias("ys"))
    return x.crossJoin(y).select(((F.col("xa") - F.col("ya")) / F.sqrt(F.col("xs") ** 2 + F.col("ys") ** 2)).alias("z"))


def subset_margin(results: DataFrame, subset: list[str], a: str, b: str) -> DataFrame:
    """How far model a is ahead of b on the subset of tasks and on the others."""
    inside = F.col("task").isin(subset)
    gap = lambda cond: F.avg(F.when(cond & (F.col("model") == a), F.col("acc"))) - F.avg(F.when(cond & (F.col("model") == b), F.col("acc")))
    return results.agg(gap(inside).alias("inside"), gap(~inside).alias("outside"))


def fact_probe(scores: DataFrame) -> DataFrame:
    """``scores(item, choice, total, tokens)``, choice 0 the gold: share of items whose best mean log likelihood is the gold's, gold first on ties."""
    best = scores.groupBy("item").agg(F.max_by("choice", F.struct(F.col("total") / F.col("tokens"), -F.col("choice"))).alias("best"))
    return best.agg(F.count("*").alias("items"), F.avg((F.col("best") == 0).cast("double")).alias("accuracy"))


def preference_accuracy(pairs: DataFrame) -> DataFrame:
    """``pairs(kind, chosen_sum, rejected_sum, chosen_n, rejected_n)``: how often the chosen is likelier, by sum and by mean, by kind and overall (null)."""
    by_sum = (F.col("chosen_sum") > F.col("rejected_sum")).cast("double")
    by_mean = (F.col("chosen_sum") / F.col("chosen_n") > F.col("rejected_sum") / F.col("rejected_n")).cast("double")
    return pairs.rollup("kind").agg(F.count("*").alias("n"), F.avg(by_sum).alias("by_sum"), F.avg(by_mean).alias("by_mean"))


def math_probe(answers: DataFrame) -> DataFrame:
    """``answers(item, answer, expected array)``: right if any expected number stands in the answer."""
    one = answers.select("item", "answer", F.explode("expected").alias("number")).withColumn("hit", has_number("answer", "number"))
    right = one.groupBy("item").agg(F.bool_or("hit").alias("right"))
    return right.agg(F.count("*").alias("items"), F.count_if("right").alias("right"))


def generative_accuracy(answers: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """Accuracy over the answered; the unanswered are reported."""
    rows = answers.select(predicted.alias("p"), gold.alias("g"))
    return rows.agg(F.count("*").alias("n"), F.count("p").alias("answered"), F.count_if(F.coalesce(F.col("p") == F.col("g"), F.lit(False))).alias("correct"), F.avg(F.when(F.col("p").isNotNull(), (F.col("p") == F.col("g")).cast("double"))).alias("acc"))


def fertility(docs: DataFrame, n_tokens: Column, group: list[str], warn_above: float = 2.7 * 1.3) -> DataFrame:
    """Tokens a word between white space, and whether that is too many."""
    n_words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    sums = docs.groupBy(*group).agg(F.sum(n_tokens).alias("tokens"), F.sum(n_words).alias("words"))
    return sums.withColumn("fertility", F.col("tokens") / F.col("words")).withColumn("warns", F.col("tokens") / F.col("words") > warn_above)


def good_ids(reviewed: DataFrame, bad: DataFrame, id_col: str = "id") -> DataFrame:
    return reviewed.select(id_col).distinct().join(bad.select(id_col), id_col, "left_anti")


# benchmark rows in one form

def exams_item(question: Column, choices: Column, key: Column, letters: str = "ABCDE") -> tuple[Column, Column]:
    """``(item, ok)``: letters become indexes; rows with an unknown key, under two choices or a key out of range are not ok."""
    gold = F.instr(F.lit(letters), key) - 1
    item = F.struct(F.trim(question).alias("question"), F.transform(choices, F.trim).alias("choices"), gold.alias("gold"))
    return item, F.coalesce((F.length(key) == 1) & (gold >= 0) & (F.size(choices) >= 2) & (gold < F.size(choices)), F.lit(False))


def copa_item(premise: Column, asks_cause: Column, choice1: Column, choice2: Column, label: Column, because: str = "затоа што", so: str = "па затоа") -> Column:
    low = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    question = F.concat(F.regexp_replace(premise, r"\.+$", ""), F.lit(", "), F.when(asks_cause, F.lit(because)).otherwise(F.lit(so)))
    return F.struct(question.alias("question"), F.array(low(choice1), low(choice2)).alias("choices"), label.alias("gold"))


def include_item(question: Column, options: list[Column], answer: Column, letters: str = "ABCD") -> tuple[Column, Column]:
    """Options that are there, and an answer given as number or letter."""
    kept = F.filter(F.array(*options), lambda x: F.coalesce(x != "", F.lit(False)))
    letter = F.instr(F.lit(letters), F.upper(F.trim(answer))) - 1
    gold = F.coalesce(answer.try_cast("int"), F.when((letter >= 0) & (F.length(F.trim(answer)) == 1), letter))
    return F.struct(F.trim(question).alias("question"), F.transform(kept, F.trim).alias("choices"), gold.alias("gold")), F.coalesce(gold < F.size(kept), F.lit(False))


def choice_prompt(question: Column, choices: Column, ask: str = "Прашање: ", answer: str = "\nОдговор:") -> Column:
    """A question with its choices lettered, one to a line."""
    listed = F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c))
    return F.concat(F.lit(ask), question, F.lit("\n"), F.array_join(listed, "\n"), F.lit(answer))


def render_chat(turns: Column, user: str = "<|turn>user\n", model: str = "<|turn>model\n", end: str = "<turn|>\n", bos: str = "<bos>") -> Column:
    """Turns between marks; a system text goes before the first user's text; no leading start mark, which the tokenizer adds."""
    system = F.filter(turns, lambda t: t["role"] == "system")
    rest = F.filter(turns, lambda t: t["role"] != "system")
    lead = F.when(F.size(system) > 0, F.concat(F.array_join(F.transform(system, lambda t: t["text"]), "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    body = F.transform(rest, lambda t, i: F.concat(F.when(t["role"] == "assistant", F.lit(model)).otherwise(F.lit(user)), F.when(i == 0, lead).otherwise(F.lit("")), t["text"], F.lit(end)))
    return F.regexp_replace(F.array_join(body, ""), "^" + "".join("\\" + c if not c.isalnum() else c for c in bos), "")
