"""Query understanding and routing over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import rules
from tessera.functions import text as T
from tessera.operators.dictionary import contained
from tessera.operators.retrieval import small


def faq_lookup(q: DataFrame, faq: DataFrame, drop: str = rules.NORMALIZE_DROP) -> DataFrame:
    """Q2: answer of the most frequent entry with the same normalised text; an empty key is a miss."""
    best = Window.partitionBy("key").orderBy(F.desc("frequency"), "answer")
    one = faq.withColumn("nth", F.row_number().over(best)).where("nth = 1 and key <> ''").select("key", "answer")
    return q.withColumn("key", T.normalize(F.col("query"), drop)).join(one, "key", "left")


def faq_hot(keys: DataFrame, k: int) -> DataFrame:
    """Q3: the k most asked keys."""
    return keys.groupBy("key").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "key").limit(k)


def faq_counts(keys: DataFrame, by=("day",)) -> DataFrame:
    """Q3: by, key, hits: exact counts to be stored and merged."""
    return keys.groupBy(*by, "key").agg(F.count("*").alias("hits"))


def faq_hot_counted(counts: DataFrame, k: int) -> DataFrame:
    """Q3 from stored counts: key, hits of the k most asked over all their rows, ties by key."""
    return counts.groupBy("key").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), F.asc_nulls_last("key")).limit(k)


def faq_sketches(keys: DataFrame, by=("day",), items: int = 10_000) -> DataFrame:
    """Q3: a row of by with a sketch of its most asked keys, to be stored and merged. A sketch tracks `items` keys at most; its counts are exact while there are no more, but of keys with equal hits any may be told: faq_counts has no such limit."""
    return keys.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(key, {int(items)})").alias("sketch"))


def faq_hot_merged(sketches: DataFrame, k: int, items: int = 10_000) -> DataFrame:
    """Q3 from stored sketches: key, hits of the k most asked over all their rows."""
    met = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {int(items)})").alias("s"))
    found = met.select(F.explode(F.expr(f"approx_top_k_estimate(s, {min(int(items), 2 * int(k) + 1000)})")).alias("x")).select(F.col("x.item").alias("key"), F.col("x.count").alias("hits"))
    return found.orderBy(F.desc("hits"), "key").limit(k)


def cache_key(intent: Column, q: Column, role: Column | None = None, drop: str = rules.NORMALIZE_DROP) -> Column:
    """Q4: result:{intent}:{md5 of the normalised query}; with a role, answers stay within it."""
    parts = [F.lit("result"), intent, *([role] if role is not None else []), F.md5(T.normalize(q, drop))]
    return F.concat_ws(":", *parts)


def domain_guard(q: Column, role: Column, words=rules.DOMAIN_WORDS, block=rules.BLOCK_WORDS, internal=rules.INTERNAL_ROLES) -> Column:
    """Q5: pass, greeting or reject."""
    s = T.strip(q)
    short = F.when(role.isin(*internal), F.length(s) < 2).otherwise(F.length(s) <= 2)
    return F.when(T.contains_any(s, words), "pass").when(short, "greeting").when(T.contains_any(s, block), "reject").otherwise("pass")


def rule_intent(q: Column, table=None) -> Column:
    """Q6: the first intent with a keyword in q; null if none."""
    table = rules.INTENT_RULES if table is None else table
    return F.coalesce(*[F.when(T.contains_any(q, words), F.lit(intent)) for intent, words in table.items()])


def classify_cascade(rule: Column, model_intent: Column, model_confidence: Column) -> Column:
    """Q7: struct<intent, confidence, source> of the first layer that answers."""
    made = lambda i, c, s: F.struct(i.alias("intent"), c.cast("double").alias("confidence"), F.lit(s).alias("source"))
    return F.when(rule.isNotNull(), made(rule, F.lit(0.95), "rule")).when(model_intent.isNotNull(), made(model_intent, model_confidence, "model")).otherwise(made(F.lit("闲聊寒暄"), F.lit(0.3), "fallback"))


def classify(df: DataFrame, q: str, model=None, table=None) -> DataFrame:
    """Q6, Q7: only queries without a rule reach the model, a DataFrame -> DataFrame that adds model_intent and model_confidence."""
    x = df.withColumn("rule", rule_intent(F.col(q), table))
    blank = {"model_intent": F.lit(None).cast("string"), "model_confidence": F.lit(None).cast("double")}
    hit, rest = x.where("rule is not null").withColumns(blank), x.where("rule is null")
    rest = rest.withColumns(blank) if model is None else model(rest)
    return hit.unionByName(rest).withColumn("c", classify_cascade(F.col("rule"), F.col("model_intent"), F.col("model_confidence"))).select(*df.columns, "c.*")


def confidence_gate(intent: Column, confidence: Column, thresholds=None, default: float = 0.5) -> Column:
    """Q8: struct<intent, reject, reason>."""
    thresholds = rules.INTENT_THRESHOLDS if thresholds is None else thresholds
    least = F.coalesce(*[F.when(intent == i, F.lit(t)) for i, t in thresholds.items()], F.lit(default))
    low = confidence < least
    new = F.when(low & (confidence < 0.35), F.lit("out_of_domain")).otherwise(intent)
    reason = F.when(intent == "out_of_domain", "out_of_domain").when(low & (confidence < 0.35), "out_of_domain").when(low, "low_confidence").otherwise("")
    return F.struct(new.alias("intent"), (reason != "").alias("reject"), reason.alias("reason"))


def link_longest(q: Column, names, aliases: dict | None = None) -> Column:
    """Q9, Q11, Q12: the longest name contained, canonical through aliases."""
    found = T.longest_contained(q, names)
    if not aliases:
        return found
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return T.once(found, lambda f: F.coalesce(F.try_element_at(table, f), f))


def link_names(df: DataFrame, q: str, names: DataFrame, prefix: int = 2, few: int | None = None) -> DataFrame:
    """Q10 for dictionary tables: (…, mention) of every name that q contains, however short.

    few: names of one automaton, more are worked off in parts (dictionary.contained). prefix no
    longer matters and is kept for its callers.
    """
    return contained(df, q, names, most=None if few is None else max(1, few))


def link_products(q: Column, names, pattern: str = rules.PRODUCT_PATTERN, insurers=rules.INSURERS) -> Column:
    """Q10: all names contained, in dictionary order; else the pattern's distinct finds that are no insurer."""
    listed = F.array_compact(F.array(*[F.when(q.contains(n), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    found = F.array_except(F.array_distinct(F.regexp_extract_all(q, F.lit(pattern), F.lit(1))), F.array(*[F.lit(i) for i in insurers]))
    return T.once(listed, lambda names: F.when(F.size(names) > 0, names).otherwise(found))


def disease_of(q: Column, known=(), table=None) -> Column:
    """Q11: struct<name, category>: from the graph's names, else from the fixed map; category 其他 if unknown."""
    table = rules.DISEASES if table is None else table
    category = {d: c for c, ds in table.items() for d in ds}  # the last category wins
    name = F.coalesce(T.longest_contained(q, list(known)), T.longest_contained(q, list(category)))
    kind = lambda n: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in category.items() for x in kv]), n), F.lit("其他"))
    return T.once(name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), kind(n).alias("category"))))


def dimensions(q: Column, table=rules.DIMENSIONS) -> Column:
    """Q13: tags whose pattern matches, in table order."""
    return F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(tag)) for tag, p in table]))


def entities(q: Column, insurers=rules.INSURERS, aliases=None, products=(), diseases=(), events=rules.EVENT_WORDS, table=rules.DIMENSIONS) -> Column:
    """Q14: struct<insurer, products, disease, event, dimensions, all_entities>, all_entities in that fixed order."""
    linked = F.struct(
        link_longest(q, insurers, rules.INSURER_ALIASES if aliases is None else aliases).alias("insurer"), link_products(q, products).alias("products"),
        F.coalesce(T.longest_contained(q, list(diseases)), T.longest_contained(q, list(dict.fromkeys(d for ds in rules.DISEASES.values() for d in ds)))).alias("disease"),
        link_longest(q, events).alias("event"), dimensions(q, table).alias("dimensions"),
    )
    tagged = lambda x, kind: F.when(x[kind].isNotNull(), F.concat_ws(":", F.lit(kind), x[kind]))
    every = lambda x: F.array_compact(F.concat(F.array(tagged(x, "insurer")), F.transform(x["products"], lambda p: F.concat(F.lit("product:"), p)), F.array(tagged(x, "disease"), tagged(x, "event"))))
    return T.once(linked, lambda x: F.struct(*[x[k].alias(k) for k in ("insurer", "products", "disease", "event", "dimensions")], every(x).alias("all_entities")))


def entities_regex(q: Column, insurers=rules.INSURERS, pattern: str = rules.PRODUCT_PATTERN_SHORT) -> Column:
    """Q15: the first insurer listed and the first product-like find."""
    return F.struct(T.first_contained(q, insurers).alias("insurer"), F.when(q.rlike(pattern), F.regexp_extract(q, pattern, 1)).alias("product_name"))


def constraints(q: Column, mode: str = "fixed", waiting=None, deductible=None, types=rules.PRODUCT_TYPES) -> Column:
    """Q16: struct<max_waiting_days, max_deductible, product_type>; strict keeps the narrow published patterns."""
    w = (waiting or rules.WAITING_ASKED)[mode]
    d = (deductible or rules.DEDUCTIBLE_ASKED)[mode]
    amount = F.expr("try_cast(null as bigint)") if d is None else F.regexp_extract(q, d, 1).try_cast("bigint")
    return F.struct(
        F.regexp_extract(q, w, 1).try_cast("int").alias("max_waiting_days"),
        (amount * F.when(F.regexp_extract(q, d, 0).contains("万"), 10_000).otherwise(1)).alias("max_deductible"),
        T.first_contained(q, types).alias("product_type"),
    )


def count_products(q: Column, names, pattern: str = rules.PRODUCT_PATTERN, insurers=rules.INSURERS) -> Column:
    """Q17"""
    return F.size(link_products(q, names, pattern, insurers))


def is_vague(q: Column, n_entities: Column, least: int = 8) -> Column:
    """Q18"""
    return (F.length(T.strip(q)) < least) & (n_entities == 0)


def select_strategy(intent: Column, n_products: Column, vague: Column, compare: str = "产品对比", premium: str = "保费试算") -> Column:
    """Q19"""
    return F.when(intent == compare, "compare").when(intent == premium, "conditional").when(n_products >= 2, "sub_query").when(vague, "hyde").otherwise("direct")


def subqueries(q: Column, products: Column, dims: Column, compare: Column) -> Column:
    """Q20: products times dimensions; products alone ask their clauses; compare asks the three usual ones."""
    crossed = F.flatten(F.transform(products, lambda p: F.transform(dims, lambda d: F.concat(p, F.lit(" "), d))))
    alone = F.transform(products, lambda p: F.concat(p, F.lit(" 条款")))
    compared = F.transform(products, lambda p: F.concat(p, F.lit(" 保障范围 保费 免赔额")))
    return F.when(F.size(products) == 0, F.array(q)).when(compare, compared).when(F.size(dims) > 0, crossed).otherwise(alone)


def complexity(faq_hit: Column, guard: Column, reject: Column, intent: Column, n_products: Column, q: Column, complex_=rules.COMPLEX_INTENTS, trivial=rules.TRIVIAL_INTENTS, core=rules.CORE_WORDS) -> Column:
    """Q21: 0, 1 or 2."""
    s = T.strip(q)
    brief = (F.length(s) <= 4) & ~T.contains_any(s, core)
    return (
        F.when(faq_hit | (guard != "pass") | reject | intent.isin(*trivial), 0).when(intent.isin(*complex_) | (n_products >= 2), 2).when(brief, 0).otherwise(1)
    )


def routes(spark, table=rules.ROUTES) -> DataFrame:
    return spark.createDataFrame(list(table), "intent string, primary string, secondary string, mode string")


def route(df: DataFrame, table: DataFrame, core=rules.CORE_WORDS, complex_=rules.COMPLEX_INTENTS) -> DataFrame:
    """Q22: (…, query, intent) -> primary, secondary, mode; brief queries and unknown intents fall back."""
    s = T.strip(F.col("query"))
    brief = (F.length(s) <= 4) & ~F.col("intent").isin(*complex_) & ~T.contains_any(s, core)
    x = df.join(small(table), "intent", "left")
    return x.withColumns({
        "primary": F.coalesce("primary", F.lit("service")),
        "mode": F.when(brief, F.lit("rag_fallback")).otherwise(F.coalesce("mode", F.lit("rag_fallback"))),
    })


def build_tasks(routed: DataFrame, secondary=rules.SECONDARY_INTENTS) -> DataFrame:
    """Q23: one or two tasks a query; the second waits for the first."""
    derived = F.coalesce(*[F.when((F.col("intent") == a) & (F.col("secondary") == b), F.lit(c)) for a, b, c in secondary], F.col("intent"))
    none = F.array().cast("array<string>")
    task = lambda n, agent, intent, deps, prio: F.struct(F.lit(f"task_{n}").alias("task_id"), agent.alias("agent_name"), intent.alias("task_intent"), deps.alias("dependencies"), F.lit(prio).alias("priority"))
    first = task(0, F.col("primary"), F.col("intent"), none, 10)
    second = task(1, F.col("secondary"), derived, F.array(F.lit("task_0")), 5)
    two = F.col("secondary").isNotNull() & (F.col("mode") == "multi_agent")
    return routed.withColumn("t", F.explode(F.when(two, F.array(first, second)).otherwise(F.array(first)))).select("query_id", "t.*")


def grants(spark, table: dict, column: str) -> DataFrame:
    return spark.createDataFrame([(tool, v) for tool, vs in table.items() for v in vs], f"tool string, {column} string")


def tool_grants(requests: DataFrame, domains: DataFrame, roles: DataFrame) -> DataFrame:
    """Q24: (…, domain, role) -> tool allowed for both."""
    return requests.join(small(domains), "domain").join(small(roles), ["tool", "role"])


def with_channel(df: DataFrame, role: str = "role", user: str = "user_id", known=("customer", *rules.INTERNAL_ROLES)) -> DataFrame:
    """Q25: role (unknown: customer), channel, and whether a customer lacks a user id."""
    r = F.when(F.col(role).isin(*known), F.col(role)).otherwise("customer")
    return df.withColumns({"role_norm": r, "channel": F.when(r == "customer", "customer").otherwise("agent"), "missing_user": (r == "customer") & (F.coalesce(F.col(user).cast("string"), F.lit("")) == "")})
