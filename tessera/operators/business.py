"""Lookups over policies, claims, rates and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.dictionary import contained
from tessera.operators.retrieval import small


def own_user(role: Column, self_id: Column, asked: Column) -> Column:
    """Row-level isolation: customers see their own rows, others those asked for (null: all)."""
    return F.when(role == "customer", self_id).otherwise(asked)


def policy_lookup(req: DataFrame, policies: DataFrame, most: int = 5) -> DataFrame:
    """B1: (request_id, role, self_id, user_id, insurer, product_name) -> newest valid policies.

    Names match by containment, literally. Requests for a user meet policies on the user;
    requests without one, which only staff can make, meet the distinct insurers or products that
    hold the name they ask for; without any name they all get the same newest policies.
    """
    r = req.withColumn("who", own_user(F.col("role"), F.col("self_id"), F.col("user_id")))
    r = r.select("request_id", "role", "who", F.col("insurer").alias("r_insurer"), F.col("product_name").alias("r_product"))
    live = policies.where("is_valid")
    fits = (F.col("r_insurer").isNull() | F.col("insurer").contains(F.col("r_insurer"))) & (F.col("r_product").isNull() | F.col("product_name").contains(F.col("r_product")))
    keyed = live.join(r.where("who is not null"), F.col("user_id") == F.col("who")).where(fits)
    staff = r.where("who is null and role <> 'customer'")
    by_insurer, by_product = staff.where("r_insurer is not null"), staff.where("r_insurer is null and r_product is not null")
    by_date = [F.desc("effective_date"), *[F.col(c) for c in policies.columns if c not in ("effective_date", "is_valid")]]

    def few(df, *keys):
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_date))).where(F.col("nth") <= most).drop("nth")

    # requests with the same names share one answer: `most` policies of each insurer, then of each pair of names
    asks = by_insurer.select("r_insurer", "r_product").distinct()
    insurers = contained(live.select("insurer").distinct(), "insurer", asks, "r_insurer", "r_insurer").join(asks, "r_insurer")
    products = contained(live.select("product_name").distinct(), "product_name", staff, "r_product", "r_product")
    named, own = live.join(products, "product_name"), live.withColumn("r_product", F.lit(None).cast("string"))
    heads = few(named, "insurer", "r_product").unionByName(few(own, "insurer")).withColumnRenamed("r_product", "p")
    met = few(heads.join(insurers, "insurer").where(F.col("p").eqNullSafe(F.col("r_product"))), "r_insurer", "r_product").drop("p")
    same = (met["r_insurer"] == by_insurer["r_insurer"]) & met["r_product"].eqNullSafe(by_insurer["r_product"])
    shape = [*live.columns, *r.columns]
    open_ = met.join(by_insurer, same).drop(met["r_insurer"], met["r_product"]).select(*shape).unionByName(few(named, "r_product").join(by_product, "r_product").select(*shape))
    any_ = live.orderBy(*by_date).limit(most).crossJoin(small(staff.where("r_insurer is null and r_product is null"))).select(*shape)  # `most` policies a request
    return keyed.select(*shape).unionByName(open_).unionByName(any_).withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy(*by_date))).where(F.col("nth") <= most)


def claim_lookup(req: DataFrame, claims: DataFrame) -> DataFrame:
    """B2: (request_id, role, self_id, user_id, report_no): the claim, or nulls where none is found or allowed."""
    r = req.withColumn("who", own_user(F.col("role"), F.col("self_id"), F.col("user_id"))).select("request_id", "report_no", "who", "role")
    c = claims.select("report_no", F.col("user_id").alias("owner"), "status")
    allowed = F.when(F.col("who").isNull(), F.col("role") != "customer").otherwise(F.col("owner") == F.col("who"))
    return r.join(c, "report_no", "left").select("request_id", "report_no", F.when(allowed, F.col("status")).alias("status"))


def premium_lookup(req: DataFrame, rates: DataFrame, width: int = 5) -> DataFrame:
    """(request_id, product_name, age, sum_insured): the cheapest active rate for the age.

    A range join by age buckets: a rate stands in every bucket its ages touch.
    """
    b = rates.where("is_active").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("min_age") / width), F.floor(F.col("max_age") / width))))
    r = req.select("request_id", F.col("product_name").alias("r_product"), "age", F.col("sum_insured").alias("r_sum"), F.floor(F.col("age") / width).alias("bucket"))
    asks = r.drop("request_id").distinct()  # requests that ask the same share one answer
    met = b.join(small(asks), "bucket").where("age between min_age and max_age").where(F.col("product_name").contains(F.col("r_product")))
    met = met.where(F.col("r_sum").isNull() | (F.col("sum_insured") == F.col("r_sum")))
    cheapest = F.min(F.struct("premium_yearly", "rate_id"))  # partial on both sides of the shuffle
    best = met.groupBy(F.col("r_product").alias("p"), F.col("age").alias("a"), F.col("r_sum").alias("s")).agg(cheapest.alias("x"))
    told = r.join(best, (F.col("p") == F.col("r_product")) & (F.col("a") == F.col("age")) & F.col("s").eqNullSafe(F.col("r_sum")))
    return told.groupBy("request_id").agg(F.min(F.struct("x.premium_yearly", "x.rate_id", "age")).alias("x")).select("request_id", "x.rate_id", "x.age", "x.premium_yearly")


def compare_products(hits: DataFrame, dims: list[str], most: int = 3, chars: int = 300) -> DataFrame:
    """hits(query_id, product_name, dim, rank, text) -> a row a product, a column a dimension of its first clauses."""
    top = hits.where(F.col("rank") <= most).select("query_id", "product_name", "dim", F.struct("rank", F.substring("text", 1, chars).alias("t")).alias("x"))
    said = F.array_agg("x")
    return top.groupBy("query_id", "product_name").pivot("dim", dims).agg(F.when(F.size(said) > 0, T.join(F.transform(F.sort_array(said), lambda x: x["t"]), "\n")))


def shingles(event: Column) -> Column:
    """The event and, when longer than two characters, its distinct two-character pieces."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(event) - 1, F.lit(1))), lambda i: event.substr(i, F.lit(2)))
    return F.when(F.length(event) > 2, F.array_distinct(F.concat(F.array(event), pieces))).otherwise(F.array(event))


def claim_eligibility(hits: DataFrame, covered: str = "保险责任", excluded: str = "责任免除", most: int = 3, chars: int = 100) -> DataFrame:
    """hits(request_id, event, clause_type, rank, text) -> verdict, citations: an exclusion beats a coverage."""
    x = hits.withColumn("hit", F.exists(shingles(F.col("event")), lambda w: F.col("text").contains(w)))
    kind = F.when(F.col("hit") & (F.col("clause_type") == excluded), "excluded").when(F.col("hit") & (F.col("clause_type") == covered), "covered")
    x = x.withColumn("kind", kind)
    both = x.groupBy("request_id").agg(
        F.max((F.col("kind") == "excluded").cast("int")).alias("e"), F.max((F.col("kind") == "covered").cast("int")).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "rank", F.substring("text", 1, chars).alias("t"))))).alias("cited"),
    )
    verdict = F.when(F.col("e") == 1, "excluded").when(F.col("c") == 1, "covered").otherwise("unknown")
    own = F.slice(F.filter("cited", lambda s: s["kind"] == F.col("verdict")), 1, most)
    return both.withColumn("verdict", verdict).select("request_id", "verdict", F.transform(own, lambda s: s["t"]).alias("citations"))


def product_lookup(req: DataFrame, products: DataFrame) -> DataFrame:
    """The product of each code, nulls where there is none."""
    return req.join(products, "code", "left")


def insurer_products(req: DataFrame, products: DataFrame) -> DataFrame:
    """Insurer, names: its active products by name."""
    live = products.where("is_active").join(req.select("insurer").distinct(), "insurer", "left_semi")
    return live.groupBy("insurer").agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "code"))), lambda x: x["name"]).alias("names"))


def newest(df: DataFrame, key: str, date: str, most: int, fields: list[str], out: str) -> DataFrame:
    nth = Window.partitionBy(key).orderBy(F.desc(date), *fields)
    few = df.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most)
    return few.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))


def user_profile(users: DataFrame, policies: DataFrame, claims: DataFrame, most: int = 10) -> DataFrame:
    """user_id, policies, claims (the newest of each, nested), has_data."""
    p = newest(policies, "user_id", "effective_date", most, ["product_name", "insurer", "status"], "policies")
    c = newest(claims, "user_id", "submitted_at", most, ["report_no", "status"], "claims")
    out = users.join(p, "user_id", "left").join(c, "user_id", "left")
    return out.withColumn("has_data", F.col("policies").isNotNull() | F.col("claims").isNotNull())


def profile_summary(policies: Column, claims: Column, most: int = 3) -> Column:
    """The first policies and claims in words; empty without data."""
    p = F.array_join(F.transform(F.slice(policies, 1, most), lambda x: F.concat(x["product_name"], F.lit("("), x["insurer"], F.lit(", "), x["status"], F.lit(")"))), "; ")
    c = F.array_join(F.transform(F.slice(claims, 1, most), lambda x: F.concat(x["report_no"], F.lit("("), x["status"], F.lit(")"))), "; ")
    say = lambda name, n, body: F.when(F.coalesce(F.size(n), F.lit(0)) > 0, F.concat(F.lit(f"  • {name}("), F.size(n).cast("string"), F.lit("): "), body))
    body = F.concat_ws("\n", say("已购保单", policies, p), say("理赔记录", claims, c))
    return F.when(body != "", F.concat(F.lit("用户画像:\n"), body)).otherwise("")
