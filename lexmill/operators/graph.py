"""Graphs of rules: edges, reachability, causes, and belief propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import shared
from ..functions.text import let

# Families of names that suggest a logical chain; weights and biases of edge types.
CHAINS = {
    "保修": ["质量保修", "保修书", "保修期", "保修期限", "保修金"],
    "付款": ["付款比例", "付款期限", "付款节点", "付款逾期", "工程款"],
    "违约金": ["违约金上限", "违约金基数", "违约金比例", "逾期违约金"],
    "验收": ["竣工验收", "验收程序", "验收标准", "验收报告"],
    "争议": ["争议解决", "管辖法院", "协商前置", "仲裁"],
    "质保": ["质量保修书", "质保期", "质保金", "保修"],
    "担保": ["履约担保", "投标保证金", "担保比例"],
}
CATEGORY_WEIGHT, CLAUSE_WEIGHT, CHAIN_WEIGHT = 0.5, 0.4, 0.6
#: By edge type: what is added to the potential of (pass, pass), (fail, fail), (pass, fail), (fail, pass), times the weight.
BIAS = {"SHARES_ENTITY": (0.45, 0.45, -0.225, -0.225), "SAME_CATEGORY": (0.30, 0.30, -0.10, -0.10), "LOGICAL_CHAIN": (0.175, 0.35, 0.0, -0.105), "CLAUSE_TYPE_CHAIN": (0.20, 0.20, 0.0, 0.0)}


def reliable(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def edges(rules: DataFrame, chains: dict[str, list[str]] | None = None) -> DataFrame:
    """(src, dst, edge_type, weight), both ways, of rules (rule_id, name, category, clause_type, entities).

    Each kind of edge is an equi-join on what the rules share, so pairs that share nothing are never made.
    """
    a = rules.select("rule_id", "name", "category", "clause_type", F.array_distinct(F.filter("entities", lambda e: F.length(e).between(2, 8))).alias("entities"))

    def pairs(keyed: DataFrame) -> DataFrame:
        other = keyed.select("key", F.col("rule_id").alias("dst"))
        return keyed.withColumnRenamed("rule_id", "src").join(other, "key").where("src < dst")

    entity = pairs(a.select("rule_id", F.explode("entities").alias("key"))).groupBy("src", "dst").agg(F.count("*").alias("k"))
    sizes = a.select("rule_id", F.size("entities").alias("n"))
    shared = entity.join(sizes.select(F.col("rule_id").alias("src"), F.col("n").alias("n1")), "src").join(sizes.select(F.col("rule_id").alias("dst"), F.col("n").alias("n2")), "dst")
    out = shared.select("src", "dst", F.lit("SHARES_ENTITY").alias("edge_type"), F.least(F.lit(1.0), F.col("k") / (F.col("n1") + F.col("n2") - F.col("k")) * 2.0).alias("weight"))
    for col, kind, weight in (("category", "SAME_CATEGORY", CATEGORY_WEIGHT), ("clause_type", "CLAUSE_TYPE_CHAIN", CLAUSE_WEIGHT)):
        out = out.unionByName(pairs(a.where(F.coalesce(F.col(col), F.lit("")) != "").select("rule_id", F.col(col).alias("key"))).select("src", "dst", F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight")))
    told = F.concat_ws(" ", "name", F.array_join("entities", " "))
    families = F.array(*(F.when(told.rlike("|".join(hints)), F.lit(k)) for k, hints in (chains or CHAINS).items()))
    chain = pairs(a.select("rule_id", F.explode(F.filter(families, lambda f: f.isNotNull())).alias("key"))).select("src", "dst", F.lit("LOGICAL_CHAIN").alias("edge_type"), F.lit(CHAIN_WEIGHT).alias("weight"))
    one_way = out.unionByName(chain)
    return one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight"))


def components(nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(id, component): the smallest node that each node reaches over undirected links (src, dst).

    Labels spread to neighbours and then to the label's own label, so the number of rounds grows with
    the logarithm of the longest path; each round is cut by a checkpoint.
    """
    both = reliable(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = reliable(nodes.select(F.col(id_col).alias("node"), F.col(id_col).alias("component")))
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.src, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = reliable(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component")))
        if new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new.withColumnRenamed("node", id_col)
        labels = new


def closure(nodes: DataFrame, links: DataFrame, id_col: str = "rule_id") -> DataFrame:
    """(src, dst) of all nodes that reach each other: as edges are mirrored, those of one component."""
    c = components(nodes, links, id_col)
    return c.select(F.col(id_col).alias("src"), "component").join(c.select(F.col(id_col).alias("dst"), "component"), "component").where("src <> dst").select("src", "dst")


def causes(verdicts: DataFrame, links: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, rule_id, causal_class, dependency_class) of failed rules.

    A failed rule that shares an edge with another failed rule of the same document is a consequence,
    both ways as edges are mirrored. One without is called a root cause by the causal report, and
    isolated by dependency resolution; both names are given.
    """
    failed = verdicts.where("status = 'FAILED'").select(by, "rule_id").distinct()
    near = failed.join(F.broadcast(links.select(F.col("src").alias("rule_id"), "dst").distinct()), "rule_id")  # links of one package
    hit = near.join(failed.withColumnRenamed("rule_id", "dst"), [by, "dst"], "left_semi").select(by, "rule_id").distinct().withColumn("hit", F.lit(True))
    linked = failed.join(hit, [by, "rule_id"], "left")
    return linked.select(by, "rule_id", F.when(F.col("hit"), "consequence").otherwise("root_cause").alias("causal_class"), F.when(F.col("hit"), "consequence").otherwise("isolated").alias("dependency_class"))


def cause_rows(verdicts: DataFrame, links: list[tuple[str, str]], by: str = "doc_id") -> DataFrame:
    """causes() for rows of rules.judged() and the links of one package: no join and no shuffle."""
    near: dict[str, list[str]] = {}
    for src, dst in links:
        near.setdefault(src, []).append(dst)
    reach = F.create_map(*(c for src, dsts in near.items() for c in (F.lit(src), F.array(*map(F.lit, dsts)))))
    failed = F.array_distinct(F.transform(F.filter("verdicts", lambda x: x["v"]["status"] == "FAILED"), lambda x: x["rule_id"]))
    hit = lambda r, all_: F.coalesce(F.arrays_overlap(F.try_element_at(reach, r), all_), F.lit(False)) if near else F.lit(False)
    name = lambda r, all_, other: F.when(hit(r, all_), "consequence").otherwise(other)
    rows = let(failed, lambda all_: F.transform(all_, lambda r: F.struct(r.alias("rule_id"), name(r, all_, "root_cause").alias("causal_class"), name(r, all_, "isolated").alias("dependency_class"))))
    return verdicts.select(by, F.explode_outer(rows).alias("r")).where("r.rule_id is not null").select(by, "r.*")


def mermaid(links: DataFrame) -> DataFrame:
    """(text): a flow chart of the edges, one line for each pair in order."""
    lines = links.select("src", "dst").distinct().select(F.format_string("    %s --> %s", "src", "dst").alias("line"))
    return lines.agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("text"))


def factors(links: DataFrame) -> DataFrame:
    """(factor, a, b, pp, ff, pf, fp): normalised potentials of each directed edge."""
    w, kind = F.col("weight"), F.col("edge_type")

    def bias(i: int) -> Column:
        out = F.lit(0.0)
        for k, v in BIAS.items():
            out = F.when(kind == k, F.lit(float(v[i]))).otherwise(out)
        return out

    # edges of one kind between two rules, of several families, are factors of their own
    each = links.groupBy("src", "dst", "edge_type", "weight").agg(F.count("*").cast("int").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    raw = each.select(F.xxhash64("src", "dst", "edge_type", "weight", "copy").alias("factor"), F.col("src").alias("a"), F.col("dst").alias("b"), *((0.25 + bias(i) * w).alias(k) for i, k in enumerate(("pp", "ff", "pf", "fp"))))
    total = F.col("pp") + F.col("ff") + F.col("pf") + F.col("fp")
    return raw.select("factor", "a", "b", *((F.col(k) / total).alias(k) for k in ("pp", "ff", "pf", "fp")))


def propagate(priors: DataFrame, links: DataFrame, observed: DataFrame, rounds: int = 50, damping: float = 0.5, least: float = 0.001) -> DataFrame:
    """(rule_id, prior, belief, posterior, entropy): sum-product over the rules of one package.

    Messages are rows, one for each factor and end; a round is one join and one aggregation, cut by a
    checkpoint. Observed rules are held at 0.99 or 0.01; rules without factors keep their prior.
    """
    clamp = lambda c: F.greatest(F.lit(0.01), F.least(F.lit(0.99), c))
    seen = observed.select("rule_id", F.when(F.col("status") == "PASSED", 0.99).when(F.col("status") == "FAILED", 0.01).alias("held"))
    rules = reliable(priors.select("rule_id", clamp(F.col("prior")).alias("prior")).join(seen, "rule_id", "left").withColumn("belief", F.coalesce("held", "prior")))
    f = factors(links)
    # one row for each factor and end: potentials seen from `rule_id` (to) with `other` (from) as the neighbour
    ends = f.select("factor", F.col("a").alias("to"), F.col("b").alias("other"), "pp", F.col("pf").alias("p_other_f"), F.col("fp").alias("f_other_p"), "ff").unionByName(f.select("factor", F.col("b").alias("to"), F.col("a").alias("other"), "pp", F.col("fp").alias("p_other_f"), F.col("pf").alias("f_other_p"), "ff"))
    ends = reliable(ends)
    messages = ends.select("factor", "to", F.lit(0.5).alias("m"), F.lit(False).alias("sent"))
    for _ in range(rounds):
        held = messages.groupBy(F.col("to").alias("rule_id")).agg(F.sum(F.log("m")).alias("lp"), F.sum(F.log(1 - F.col("m"))).alias("lf"), F.count("*").alias("k"))
        at = messages.select("factor", F.col("to").alias("rule_id"), "m").join(held, "rule_id").join(rules.select("rule_id", "held", "belief"), "rule_id")
        odds = F.exp((F.col("lp") - F.log("m")) - (F.col("lf") - F.log(1 - F.col("m"))))
        out = at.select("factor", F.col("rule_id").alias("other"), F.coalesce("held", F.when(F.col("k") > 1, odds / (1 + odds)).otherwise(F.col("belief"))).alias("v"))
        p, q = F.col("pp") * F.col("v") + F.col("p_other_f") * (1 - F.col("v")), F.col("f_other_p") * F.col("v") + F.col("ff") * (1 - F.col("v"))
        fresh = ends.join(out, ["factor", "other"]).select("factor", "to", (p / (p + q)).alias("new"))
        mixed = F.when(F.col("sent"), damping * F.col("m") + (1 - damping) * F.col("new")).otherwise(F.col("new"))
        messages = reliable(messages.join(fresh, ["factor", "to"]).select("factor", "to", mixed.alias("m"), F.lit(True).alias("sent")))
        marginal = messages.groupBy(F.col("to").alias("rule_id")).agg(F.exp(F.sum(F.log("m")) - F.sum(F.log(1 - F.col("m")))).alias("odds"))
        updated = reliable(rules.join(marginal, "rule_id", "left").select("rule_id", "prior", "held", F.coalesce("held", F.col("odds") / (1 + F.col("odds")), "belief").alias("belief")))
        moved = updated.join(rules.select("rule_id", F.col("belief").alias("old")), "rule_id").agg(F.max(F.abs(F.col("belief") - F.col("old")))).first()[0]
        rules = updated
        if (moved or 0.0) < least:
            break
    b = F.col("belief")
    entropy = F.when((b <= 0) | (b >= 1), 0.0).otherwise(-(b * F.log2(b) + (1 - b) * F.log2(1 - b)))
    return rules.select("rule_id", "prior", "belief", clamp(b * F.col("prior") + (1 - b) * (1 - F.col("prior"))).alias("posterior"), entropy.alias("entropy"))


def calibrated(runs: DataFrame) -> DataFrame:
    """(a, b, pp, pf, fp, ff): potentials from how often pairs of rules agreed over runs (run_id, rule_id, status), with one added to each count."""
    r = runs.where("status in ('PASSED', 'FAILED')").select("run_id", F.col("rule_id").alias("a"), (F.col("status") == "PASSED").alias("pa"))
    other = r.select("run_id", F.col("a").alias("b"), F.col("pa").alias("pb"))
    n = F.count("*") + 4.0
    share = lambda x, y: (F.count_if((F.col("pa") == x) & (F.col("pb") == y)) + 1) / n
    return r.join(other, "run_id").where("a < b").groupBy("a", "b").agg(share(True, True).alias("pp"), share(True, False).alias("pf"), share(False, True).alias("fp"), share(False, False).alias("ff"))
