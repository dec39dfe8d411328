"""Verification queries on the driver's tables, each with DuckDB SQL of the same meaning.

Entities are keys: customers, parts and suppliers share one id space, orders have one of their own under the
same ids. Every query names its columns alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import BatchSystem, Component, Double, Entity, Global, Int32, Program, String, System, TableView, World, match, matched, updates
from .errors import PlanError
from .sources import parquet as src
from .sources.tables import scratch_path
from .streaming.driver import FrameStream, upsert
from .world import owner


class Account(Component):
    acctbal: Double


class Segment(Component):
    mktsegment: String


class PartSpec(Component):
    size: Int32
    retailprice: Double


class Vendor(Component):
    acctbal: Double


class OrderInfo(Component):
    totalprice: Double


class Settings(Component):
    rate: Double
    bonus: Double


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def people(spark: SparkSession, sf_dir: str) -> World:
    """Customers, parts and suppliers in one id space."""
    t = lambda name: src.read(spark, f"{sf_dir}/{name}.parquet")
    world = World(spark)
    customer, part = t("customer"), t("part")
    src.component(world, Account, customer, "c_custkey", acctbal="c_acctbal")
    src.component(world, Segment, customer, "c_custkey", mktsegment="c_mktsegment")
    src.component(world, PartSpec, part, "p_partkey", size="p_size", retailprice="p_retailprice")
    src.component(world, Vendor, t("supplier"), "s_suppkey", acctbal="s_acctbal")
    src.tag(world, "building", customer, "c_custkey", F.col("c_mktsegment") == "BUILDING")
    src.tag(world, "big", part, "p_partkey", F.col("p_size") > 25)
    src.reference(world, "home", customer, "c_custkey", "c_nationkey")
    src.reference(world, "parent", part.where("p_partkey >= 1"), "p_partkey", F.expr("p_partkey div 2"))
    return world


def ordering(spark: SparkSession, sf_dir: str) -> World:
    """Orders, and customers under the same kind of id, linked by buyer."""
    world = people(spark, sf_dir)
    orders = src.read(spark, f"{sf_dir}/orders.parquet")
    src.component(world, OrderInfo, orders, "o_orderkey", totalprice="o_totalprice")
    src.tag(world, "urgent", orders, "o_orderkey", F.col("o_orderpriority") == "1-URGENT")
    src.tag(world, "finished", orders, "o_orderkey", F.col("o_orderstatus") == "F")
    src.reference(world, "buyer", orders, "o_orderkey", "o_custkey")
    return world


class Double_(System):
    """acctbal' = acctbal * factor."""

    writes = (Account,)

    def __init__(self, factor: float = 2.0):
        self.factor = factor

    def run(self, ctx, id, account):
        return {Account: {"acctbal": account.acctbal * self.factor}}


class AddPart(System):
    writes = (Account,)

    def run(self, ctx, id, account, part):
        return {Account: {"acctbal": account.acctbal + part.retailprice * 0.1}}


class AddAll(System):
    writes = (Account,)

    def run(self, ctx, id, account, part, vendor):
        return {Account: {"acctbal": account.acctbal + part.retailprice + vendor.acctbal}}


class Grow(System):
    """acctbal' = acctbal + step."""

    writes = (Account,)

    def __init__(self, step: float):
        self.step = step

    def run(self, ctx, id, account):
        return {Account: {"acctbal": account.acctbal + self.step}}


class Price(System):
    """retailprice' = retailprice + step."""

    writes = (PartSpec,)

    def __init__(self, step: float):
        self.step = step

    def run(self, ctx, id, part):
        return {PartSpec: {"retailprice": part.retailprice + self.step}}


def accounts(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("Account_acctbal").alias("acctbal"))


def table(world: World) -> DataFrame:
    return world.rows(Account).select("id", "acctbal")


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer")
def q01_scan_foreach(spark, d):
    return accounts(updates(match(Account).foreach(Double_()), people(spark, d)))


MATCH_SQL = "SELECT c_custkey AS id, c_acctbal + p_retailprice * 0.1::DOUBLE AS acctbal FROM customer JOIN part ON c_custkey = p_partkey"


@query(MATCH_SQL + " WHERE c_acctbal > 0 AND p_size > 10")
def q02_match_join(spark, d):
    """Flagship: two components of one entity, a predicate over both, an update."""
    stmt = match(Account, PartSpec).filter(lambda a, p: (a.acctbal > 0) & (p.size > 10)).foreach(AddPart())
    return accounts(updates(stmt, people(spark, d)))


@query("SELECT c_custkey AS id, c_acctbal + p_retailprice + s_acctbal AS acctbal FROM customer JOIN part ON c_custkey = p_partkey JOIN supplier ON c_custkey = s_suppkey")
def q03_three_way_match(spark, d):
    return accounts(updates(match(Account, PartSpec, Vendor).foreach(AddAll()), people(spark, d)))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def q04_has_tag(spark, d):
    return accounts(updates(match(Account).has_tag("building").foreach(Double_()), people(spark, d)))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def q05_has_not_tag(spark, d):
    return accounts(updates(match(Account).has_not_tag("building").foreach(Double_()), people(spark, d)))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def q06_tag_combo(spark, d):
    return accounts(updates(match(Account).has_tag("building").has_not_tag("big").foreach(Double_()), people(spark, d)))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def q07_has_component(spark, d):
    return accounts(updates(match(Account).has_component(Vendor).foreach(Double_()), people(spark, d)))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def q08_has_not_component(spark, d):
    return accounts(updates(match(Account).has_not_component(Vendor).foreach(Double_()), people(spark, d)))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer WHERE c_acctbal < 2")
def q09_filter_fn(spark, d):
    def poor(account):
        return account.acctbal < 2

    return accounts(updates(match(Account).filter(poor).foreach(Double_()), people(spark, d)))


@query(MATCH_SQL + " WHERE c_acctbal > 100 AND p_size < 40 AND p_retailprice > c_acctbal / 10")
def q10_filter_multi(spark, d):
    stmt = match(Account, PartSpec).filter(lambda a, p: a.acctbal > 100).filter(lambda a, p: p.size < 40).filter(lambda a, p: p.retailprice > a.acctbal / 10)
    return accounts(updates(stmt.foreach(AddPart()), people(spark, d)))


class Interest(System):
    writes = (Account,)

    def run(self, ctx, id, settings, account):
        return {Account: {"acctbal": account.acctbal * settings.rate + settings.bonus}}


@query("SELECT c_custkey AS id, c_acctbal * 1.5::DOUBLE + 3 AS acctbal FROM customer")
def q11_global_cross(spark, d):
    world = people(spark, d)
    world.set_global(Settings(rate=1.5, bonus=3.0))
    return accounts(updates(match(Global(Settings), Account).foreach(Interest()), world))


@query("SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer WHERE false")
def q12_global_missing(spark, d):
    return accounts(updates(match(Global(Settings), Account).foreach(Interest()), people(spark, d)))


class Adjust(System):
    writes = (Settings,)

    def run(self, ctx, id, settings):
        return {Settings: {"rate": settings.rate * 2, "bonus": settings.bonus + settings.rate}}


@query("SELECT c_custkey AS id, c_acctbal * 3.0::DOUBLE + 4.5::DOUBLE AS acctbal FROM customer")
def q13_global_only(spark, d):
    """A statement of globals alone runs first; the accounts see what it wrote."""
    world = people(spark, d)
    world.set_global(Settings(rate=1.5, bonus=3.0))
    return table(Program(match(Global(Settings), Account).foreach(Interest()), match(Global(Settings)).foreach(Adjust())).frame(world))


class Buy(System):
    writes = (OrderInfo,)

    def run(self, ctx, id, order, account):
        return {OrderInfo: {"totalprice": order.totalprice + account.acctbal * 0.5}}


class Raise(System):
    writes = (OrderInfo,)

    def run(self, ctx, id, order):
        return {OrderInfo: {"totalprice": order.totalprice * 1.25}}


def orders(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("OrderInfo_totalprice").alias("totalprice"))


GATHER_SQL = "SELECT o_orderkey AS id, o_totalprice + c_acctbal * 0.5::DOUBLE AS totalprice FROM orders JOIN customer ON o_custkey = c_custkey"
SEMI_SQL = "SELECT o_orderkey AS id, o_totalprice * 1.25::DOUBLE AS totalprice FROM orders"


@query(GATHER_SQL)
def q14_expand_gather(spark, d):
    return orders(updates(match(OrderInfo).expand("buyer", Account).foreach(Buy()), ordering(spark, d)))


@query(SEMI_SQL + " WHERE o_custkey IS NOT NULL")
def q15_expand_empty(spark, d):
    return orders(updates(match(OrderInfo).expand("buyer").foreach(Raise()), ordering(spark, d)))


@query(SEMI_SQL + " WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q16_expand_head_tag(spark, d):
    return orders(updates(match(OrderInfo).expand("buyer").has_tag("building").foreach(Raise()), ordering(spark, d)))


@query(SEMI_SQL + " WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q17_expand_head_not_tag(spark, d):
    return orders(updates(match(OrderInfo).expand("buyer").has_not_tag("building").foreach(Raise()), ordering(spark, d)))


@query(GATHER_SQL + " WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND c_custkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def q18_expand_component_tag(spark, d):
    stmt = match(OrderInfo).has_tag("urgent").expand("buyer", Account).has_tag("building").has_not_tag("big")
    return orders(updates(stmt.foreach(Buy()), ordering(spark, d)))


@query(GATHER_SQL + " WHERE o_totalprice > 10 * c_acctbal AND o_totalprice > 1000")
def q19_expand_predicate(spark, d):
    stmt = match(OrderInfo).filter(lambda o: o.totalprice > 1000).expand("buyer", Account).filter(lambda o, a: o.totalprice > a.acctbal * 10)
    return orders(updates(stmt.foreach(Buy()), ordering(spark, d)))


@query(SEMI_SQL + " WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def q20_expand_has_component(spark, d):
    return orders(updates(match(OrderInfo).expand("buyer").has_component(Vendor).foreach(Raise()), ordering(spark, d)))


@query(GATHER_SQL + " WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def q20b_expand_has_not_component(spark, d):
    return orders(updates(match(OrderInfo).expand("buyer", Account).has_not_component(Vendor).foreach(Buy()), ordering(spark, d)))


class Inherit(System):
    """A part's price is the mean of its own and its parent's new one."""

    writes = (PartSpec,)

    def run(self, ctx, id, part, parent):
        return {PartSpec: {"retailprice": (part.retailprice + parent.retailprice) * 0.5}}


CASCADE = """
  SELECT p_partkey AS id, p_retailprice AS retailprice FROM part WHERE p_partkey = 0
  UNION ALL
  SELECT p_partkey, (p_retailprice + c.retailprice) * 0.5::DOUBLE FROM part JOIN c ON p_partkey // 2 = c.id AND p_partkey >= 1
"""


@query(f"WITH RECURSIVE c AS ({CASCADE}) SELECT id, retailprice FROM c")
def q21_cascading(spark, d):
    world = Program(match(PartSpec).expand("parent", PartSpec).foreach(Inherit())).frame(people(spark, d))
    return world.rows(PartSpec).select("id", "retailprice")


@query(
    """
WITH RECURSIVE r AS (
  SELECT p_partkey AS tail, CASE WHEN p_partkey % 21 < 7 THEN (CASE WHEN p_partkey % 21 = 6 THEN p_partkey - 6 ELSE p_partkey + 1 END) ELSE p_partkey - 7 END AS head
  FROM part WHERE p_partkey % 42 <> 27
), c AS (
  SELECT head AS id, p_retailprice AS retailprice FROM (SELECT DISTINCT head FROM r WHERE head NOT IN (SELECT tail FROM r)) LEFT JOIN part ON p_partkey = head
  UNION ALL
  SELECT p_partkey, coalesce((p_retailprice + c.retailprice) * 0.5::DOUBLE, p_retailprice) FROM part JOIN r ON p_partkey = tail JOIN c ON head = c.id
)
SELECT p_partkey AS id, coalesce(c.retailprice, p_retailprice) AS retailprice FROM part LEFT JOIN c ON c.id = p_partkey
"""
)
def q22_cascading_cycle(spark, d):
    """Rings of seven parts with parts hanging below them; some rings are cut open and become chains."""
    world = people(spark, d)
    ring = F.expr("CASE WHEN id % 21 < 7 THEN (CASE WHEN id % 21 = 6 THEN id - 6 ELSE id + 1 END) ELSE id - 7 END")
    world.add_ref("loop", world.rows(PartSpec).select("id", ring.alias("head")).where("id % 42 <> 27"))
    return Program(match(PartSpec).expand("loop", PartSpec).foreach(Inherit())).frame(world).rows(PartSpec).select("id", "retailprice")


@query("SELECT c_custkey AS id, c_acctbal + coalesce((p_retailprice + 7) * 0.1::DOUBLE, 0) AS acctbal FROM customer LEFT JOIN part ON c_custkey = p_partkey")
def q23_frame_dependency(spark, d):
    """Written second, the price change runs first."""
    return table(Program(match(Account, PartSpec).foreach(AddPart()), match(PartSpec).foreach(Price(7.0))).frame(people(spark, d)))


@query("SELECT c_custkey AS id, (c_acctbal + 10) * 2 + 1 AS acctbal FROM customer")
def q24_frame_priority(spark, d):
    stmts = [match(Account).foreach(Grow(1.0)).set_priority(5), match(Account).foreach(Double_()).set_priority(3), match(Account).foreach(Grow(10.0))]
    return table(Program(*stmts).frame(people(spark, d)))


@query("SELECT c_custkey AS id, (c_acctbal + 10) * 2 AS acctbal FROM customer")
def q25_post_frame(spark, d):
    program = Program(match(Account).foreach(Double_()).set_post_frame(), match(Account).foreach(Grow(10.0)))
    return table(program.post_frame(program.frame(people(spark, d))))


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN c_acctbal * 2 ELSE c_acctbal END AS acctbal FROM customer")
def q26_writeback_full_table(spark, d):
    return table(Program(match(Account).has_tag("building").filter(lambda a: a.acctbal > 0).foreach(Double_())).frame(people(spark, d)))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_acctbal END AS acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, -2 FROM customer WHERE c_custkey < 10")
def q27_upsert(spark, d):
    world = people(spark, d)
    rows = world.rows(Account)
    world.put(Account, rows.where("id % 3 = 0").select("id", F.lit(-1.0).alias("acctbal")).union(rows.where("id < 10").select(F.col("id") + 10000000, F.lit(-2.0))))
    return table(world)


@query("SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer WHERE c_custkey % 2 = 1")
def q28_destroy(spark, d):
    world = people(spark, d)
    world.remove(Account, world.rows(Account).where("id % 2 = 0"))
    return table(world)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal ELSE c_acctbal * 2 END AS acctbal, c_custkey % 5 <> 0 AS enabled FROM customer")
def q29_disable(spark, d):
    world = people(spark, d)
    world.disable(Account, world.rows(Account).where("id % 5 = 0"))
    return Program(match(Account).foreach(Double_())).frame(world).table(Account).select("id", "acctbal", "enabled")


@query("SELECT 'Account' AS component, c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'PartSpec', p_partkey FROM part WHERE p_partkey % 4 <> 0 OR p_partkey NOT IN (SELECT c_custkey FROM customer)")
def q30_clear_entity(spark, d):
    world = people(spark, d)
    world.clear_entity(world.rows(Account).where("id % 4 = 0").select("id"))
    parts = [world.rows(k).select(F.lit(k.__name__).alias("component"), "id") for k in (Account, PartSpec)]
    return parts[0].union(parts[1])


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT p_partkey FROM part WHERE p_size > 25")
def q31_tag_union(spark, d):
    return people(spark, d).tag_union("building", "big")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def q32_tag_difference(spark, d):
    return people(spark, d).tag_difference("building", "big")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def q33_tag_intersection(spark, d):
    return people(spark, d).tag_intersection("building", "big")


@query("SELECT 'Account' AS name, count(*) AS size FROM customer UNION ALL SELECT 'Segment', count(*) FROM customer UNION ALL SELECT 'PartSpec', count(*) FROM part UNION ALL SELECT 'Vendor', count(*) FROM supplier")
def q34_metadata(spark, d):
    return people(spark, d).metadata()


@query("SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer WHERE c_custkey // 512 % 3 = 1")
def q35_slice(spark, d):
    return people(spark, d).slice(Account, chunk=2, offset=1, stride=3).select("id", "acctbal")


@query("SELECT c_custkey AS tail, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END::BIGINT AS head FROM customer WHERE c_custkey % 7 <> 0")
def q36_reference_overwrite(spark, d):
    world = people(spark, d)
    rows = world.rows(Account)
    world.add_ref("home", rows.where("id % 2 = 0").select("id", F.lit(0).cast("long")))
    world.remove_ref("home", rows.where("id % 7 = 0").select("id"))
    return world.ref_rows("home")


class SetPrice(System):
    writes = (PartSpec,)

    def run(self, ctx, id, part):
        return {PartSpec: {"retailprice": F.lit(1.0)}}


class PriceOfParent(System):
    writes = (PartSpec,)

    def run(self, ctx, id, part, parent):
        return {PartSpec: {"retailprice": (part.retailprice + parent.retailprice) * ctx.dt}}


class FromParent(System):
    writes = (Account,)

    def run(self, ctx, id, account, parent):
        return {Account: {"acctbal": parent.retailprice * 5}}


@query(
    """
WITH RECURSIVE c AS (
  SELECT p_partkey AS id, 1.0::DOUBLE AS price FROM part WHERE p_partkey = 0
  UNION ALL
  SELECT p_partkey, (1.0::DOUBLE + c.price) * 0.1::DOUBLE FROM part JOIN c ON p_partkey // 2 = c.id AND p_partkey >= 1
), a AS (
  SELECT c_custkey AS id, CASE WHEN c.id IS NULL OR c_custkey = 0 OR c_custkey NOT IN (SELECT p_partkey FROM part) THEN c_acctbal ELSE c.price * 5 END AS bal, c_custkey // 2 AS parent
  FROM customer LEFT JOIN c ON c.id = c_custkey // 2
), b AS (
  SELECT a.id, CASE WHEN a.id >= 1 AND a.id IN (SELECT p_partkey FROM part) AND parent IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN bal + 1 ELSE bal END AS acctbal FROM a
)
SELECT 'account' AS kind, id, acctbal AS v FROM b UNION ALL SELECT 'price', id, price FROM c
"""
)
def q37_star_and_tree_frame(spark, d):
    """The golden frame on a tree of parts: reset, cascade, gather, semi join with a tag on the head."""
    program = Program(
        match(PartSpec).foreach(SetPrice()),
        match(PartSpec).expand("parent", PartSpec).foreach(PriceOfParent()).set_priority(2),
        match(Account).expand("parent", PartSpec).foreach(FromParent()),
        match(Account).expand("parent").has_tag("big").foreach(Grow(1.0)).set_priority(2),
        double=True,
    )
    world = program.frame(people(spark, d), dt=0.1, settle=True)
    one = world.rows(Account).select(F.lit("account").alias("kind"), "id", F.col("acctbal").alias("v"))
    return one.union(world.rows(PartSpec).select(F.lit("price"), "id", "retailprice"))


@query("SELECT 'Account.acctbal' AS field, 'double' AS type UNION ALL SELECT 'PartSpec.size', 'int32' UNION ALL SELECT 'PartSpec.retailprice', 'double' UNION ALL SELECT 'Segment.mktsegment', 'string'")
def q38_describe(spark, d):
    world = people(spark, d)
    rows = [(f"{k.__name__}.{f['name']}", f["type"]) for k in (Account, PartSpec, Segment) for f in world.describe(k)]
    return spark.createDataFrame(rows, "field string, type string")


@query("SELECT c_custkey AS id, c_acctbal AS acctbal, p_size AS size FROM customer JOIN part ON c_custkey = p_partkey WHERE c_mktsegment = 'BUILDING'")
def q39_matched_rows(spark, d):
    rows = matched(match(Account, PartSpec).has_tag("building").foreach(AddPart()), people(spark, d))
    return rows.select("id", "Account.acctbal", "PartSpec.size")


@query("SELECT event_id // 256 AS block, count(*) AS rows FROM events GROUP BY 1")
def q40_blocks(spark, d):
    world = World(spark)
    src.component(world, Account, src.read(spark, f"{d}/events.parquet"), "event_id", acctbal="value")
    return world.blocks(Account)


@query("SELECT c_custkey AS id, c_acctbal + 1 AS acctbal FROM customer")
def q41_snapshot(spark, d):
    """A draft's change shows only once it is committed."""
    world = people(spark, d)
    before = world.snapshot()
    draft = world.begin()
    draft = Program(match(Account).foreach(Grow(1.0))).frame(draft)
    world.commit(draft)
    assert before.state is not world.state
    return table(world)


ALL_SQL = "SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer"


@query(ALL_SQL)
def q42_rollback(spark, d):
    """A draft that is rolled back leaves nothing behind."""
    world = people(spark, d)
    draft = Program(match(Account).foreach(Grow(1.0))).frame(world.begin())
    draft.remove(Account, draft.rows(Account).where("id % 2 = 0"))
    world.rollback()
    return table(world)


@query("SELECT c_custkey AS id, c_acctbal AS acctbal, c_custkey <> 7 AS enabled FROM customer WHERE c_custkey IN (3, 7, 10)")
def q43_point_lookup(spark, d):
    """Single rows by id, disabled ones too; none for an id without a row."""
    world = people(spark, d)
    world.disable(Account, [7])
    found = [(i, world.get(Account, i), world.is_enabled(Account, i)) for i in (3, 7, 10, -5)]
    return spark.createDataFrame([(i, r["acctbal"], on) for i, r, on in found if r], "id long, acctbal double, enabled boolean")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 1")
def q44_tag_edit(spark, d):
    world = people(spark, d)
    rows = world.rows(Account)
    world.remove_tag("building", rows.where("id % 3 = 0"))
    world.add_tag("building", rows.where("id % 10 = 1"))
    return world.tag("building")


@query("SELECT 'building' AS tag, count(*) AS size, max(CASE WHEN c_custkey = 5 THEN 1 ELSE 0 END) = 1 AS has_five FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'big', 0, false")
def q45_tag_size_and_clear(spark, d):
    world = people(spark, d)
    world.clear_tag("big")
    return spark.createDataFrame([(t, world.tag_size(t), world.has_tag(t, 5)) for t in ("building", "big")], "tag string, size long, has_five boolean")


PEOPLE_IDS = "SELECT c_custkey AS id FROM customer UNION SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier"


@query(f"{PEOPLE_IDS} EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def q46_tag_complement(spark, d):
    return people(spark, d).tag_complement("building")


@query("SELECT c_custkey // 32768 AS bucket, count(*) AS bits FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def q47_tag_bitmaps(spark, d):
    """A tag as bitmaps and back: the bits of each bucket."""
    world = people(spark, d)
    bitmaps = world.tag_bitmaps("building")
    world.set_tag_bitmaps("again", bitmaps)
    counts = bitmaps.select("bucket", F.bitmap_count("bits").alias("bits"))
    same = world.tag("again").groupBy(F.expr("id div 32768").alias("bucket")).agg(F.count("*").alias("bits"))
    return counts.intersect(same)


@query("SELECT 'PartSpec' AS name, 0 AS size UNION ALL SELECT 'Segment', count(*) FROM customer UNION ALL SELECT 'Vendor', count(*) FROM supplier")
def q48_drop_and_clear_tables(spark, d):
    world = people(spark, d)
    world.drop(Account)
    world.clear_table(PartSpec)
    return world.metadata()


@query("SELECT 'tables' AS part, 0::BIGINT AS size UNION ALL SELECT 'tags', 0 UNION ALL SELECT 'refs', 0")
def q49_clear_database(spark, d):
    world = people(spark, d)
    world.clear()
    return spark.createDataFrame([(p, len(getattr(world.state, p))) for p in ("tables", "tags", "refs")], "part string, size long")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN c_acctbal ELSE c_acctbal * 2 END AS acctbal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 10 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 0")
def q50_enable(spark, d):
    """Some of the disabled rows are enabled again and take part."""
    world = people(spark, d)
    rows = world.rows(Account)
    world.disable(Account, rows.where("id % 5 = 0"))
    world.enable(Account, rows.where("id % 10 = 0"))
    return Program(match(Account).foreach(Double_())).frame(world).table(Account).select("id", "acctbal")


@query(
    "SELECT 'tag' AS kind, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 <> 0 "
    "UNION ALL SELECT 'ref', c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_nationkey % 4 <> 0 UNION ALL SELECT 'row', c_custkey FROM customer WHERE c_custkey % 4 <> 0"
)
def q51_purge_entity(spark, d):
    """Entities go from tables, tags and references, as tails and as heads."""
    world = people(spark, d)
    world.clear_entity(world.entities().where("id % 4 = 0"), purge=True)
    parts = [world.tag("building").select("id"), world.ref("home").select("tail"), world.rows(Account).select("id")]
    return parts[0].select(F.lit("tag").alias("kind"), "id").union(parts[1].select(F.lit("ref"), "tail")).union(parts[2].select(F.lit("row"), "id"))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS acctbal FROM customer WHERE false UNION ALL SELECT -1, 0")
def q52_globals(spark, d):
    """Once its global is dropped a statement matches nothing; ensured again, the global has no values yet."""
    world = people(spark, d)
    world.set_global(Settings(rate=2.0, bonus=0.0))
    world.drop_global(Settings)
    rows = accounts(updates(match(Global(Settings), Account).foreach(Interest()), world))
    empty = world.ensure_global(Settings)
    return rows.union(spark.createDataFrame([(-1, float(sum(v is not None for v in empty.values())))], "id long, acctbal double"))


class Halve(BatchSystem):
    """Opaque Python over batches."""

    writes = (Account,)

    def run_batch(self, ctx, frame):
        frame["Account.acctbal"] = frame["Account.acctbal"] / 2 + ctx.delta
        return frame


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal / 2 + 0.5 ELSE c_acctbal END AS acctbal FROM customer")
def q53_opaque_system(spark, d):
    return table(Program(match(Account).has_tag("building").foreach(Halve())).frame(people(spark, d), dt=0.5))


@query("SELECT c_custkey AS id, c_acctbal + coalesce((p_retailprice + 7) * 0.1::DOUBLE, 0) AS acctbal FROM customer LEFT JOIN part ON c_custkey = p_partkey")
def q54_single_tasks(spark, d):
    """The host drives the graph: whatever is ready runs, task by task."""
    world = people(spark, d)
    program = Program(match(Account, PartSpec).foreach(AddPart()), match(PartSpec).foreach(Price(7.0)))
    done: set[int] = set()
    while ready := program.ready(done):
        world = program.run_task(world, ready[0])
        done.add(ready[0].index)
    return table(world)


class Retire(System):
    """Poor accounts are disabled once the frame is over; until then they still grow."""

    writes = (Account,)

    def run(self, ctx, id, account):
        return {Account: {"enabled": account.acctbal >= 0}}


@query("SELECT c_custkey AS id, c_acctbal + 1 AS acctbal, c_acctbal >= 0 AS enabled FROM customer")
def q55_disable_from_a_system(spark, d):
    program = Program(match(Account).foreach(Retire()), match(Account).foreach(Grow(1.0)).set_priority(2))
    return program.frame(people(spark, d)).table(Account).select("id", "acctbal", "enabled")


@query("SELECT c_custkey // 256 AS block, c_custkey % 256 AS slot, c_custkey AS id, c_acctbal AS acctbal, c_custkey AS owner FROM customer WHERE c_custkey // 256 = 1")
def q56_block_rows(spark, d):
    """The rows of one block with their places, and the entities that own the places."""
    rows = TableView(people(spark, d), Account).block(1)
    return rows.select("block", F.col("slot").cast("long").alias("slot"), "id", "acctbal", owner(F.col("block"), F.col("slot")).alias("owner"))


@query("SELECT 3::BIGINT AS id, c_acctbal AS acctbal, true AS tagged, c_nationkey::BIGINT AS home FROM customer WHERE c_custkey = 3")
def q57_entity_handle(spark, d):
    world = people(spark, d)
    entity = Entity(world, 3).add_tag("chosen")
    return spark.createDataFrame([(3, entity.get(Account)["acctbal"], entity.has_tag("chosen"), entity.head("home").id)], "id long, acctbal double, tagged boolean, home long")


@query("SELECT 0 AS task, '' AS parents, false AS sync UNION ALL SELECT 1, '0', false UNION ALL SELECT 2, '0,1', true")
def q58_task_graph(spark, d):
    """Three statements: a writer of parts, a reader of them, a follower of a reference."""
    program = Program(match(PartSpec).foreach(Price(1.0)), match(Account, PartSpec).foreach(AddPart()), match(Account).expand("parent", PartSpec).foreach(FromParent()).set_priority(2))
    rows = [(t.index, ",".join(map(str, sorted(t.parents))), t.requires_sync) for t in program.tasks()]
    return spark.createDataFrame(rows, "task int, parents string, sync boolean")


@query("SELECT 'cyclic' AS case, 'CyclicDependency' AS error UNION ALL SELECT 'filter', 'UnsupportedStatement' UNION ALL SELECT 'name', 'ExpectedStringLiteral' UNION ALL SELECT 'priority', 'PlanError'")
def q59_validation(spark, d):
    """What is refused when a program is made, and by which error."""
    cases = {
        "cyclic": lambda: Program(match(Account, PartSpec).foreach(AddPart()), match(PartSpec, Account).foreach(PriceOfAccount())),
        "filter": lambda: match(Account).filter(3),
        "name": lambda: match(Account).has_tag(5),
        "priority": lambda: match(Account).foreach(Double_()).set_priority(-1),
    }
    rows = []
    for name, make in cases.items():
        try:
            make()
        except PlanError as error:
            rows.append((name, type(error).__name__))
    return spark.createDataFrame(rows, "case string, error string")


class PriceOfAccount(System):
    writes = (PartSpec,)

    def run(self, ctx, id, part, account):
        return {PartSpec: {"retailprice": account.acctbal}}


@query("SELECT c_custkey AS tail, c_nationkey::BIGINT AS head FROM customer WHERE c_custkey % 3 <> 0")
def q60_reference_disable(spark, d):
    """Disabled references are not followed, enabled again they are."""
    world = people(spark, d)
    rows = world.rows(Account)
    world.disable_ref("home", rows.where("id % 3 = 0 OR id % 5 = 0").select("id"))
    world.disable_ref("home", rows.where("id % 5 = 0 AND id % 3 <> 0").select("id"), on=True)
    return world.ref_rows("home")


@query("SELECT 'Account' AS name, 1::BIGINT AS bad")
def q61_repeated_ids(spark, d):
    """Tables whose ids repeat are named."""
    world = people(spark, d)
    rows = world.table(Account)
    world.replace_table(Account, rows.union(rows.where("id = 1")))
    return spark.createDataFrame([(n, 1) for n in world.validate()], "name string, bad long")


@query("SELECT c_custkey AS id, c_acctbal + 3 AS acctbal FROM customer")
def q62_several_frames(spark, d):
    return table(Program(match(Account).foreach(Grow(1.0))).run(people(spark, d), 3))


@query("SELECT event_id AS id, value + 1 AS acctbal FROM events")
def q63_stream_of_frames(spark, d):
    """Each micro-batch of events is put into the world, then a frame runs."""
    frames = FrameStream(Program(match(Account).foreach(Grow(1.0))), World(spark))
    schema = src.read(spark, f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = frames.start(events.select(F.col("event_id").alias("id"), F.col("value").alias("acctbal")), upsert(Account), scratch_path(spark), availableNow=True)
    stream.awaitTermination()
    return table(frames.world)


@query("SELECT 'foreach' AS operator, 0 AS depth UNION ALL SELECT 'predicate filter', 1 UNION ALL SELECT 'tag filter', 2 UNION ALL SELECT 'join', 3 UNION ALL SELECT 'scan', 4 UNION ALL SELECT 'scan', 4")
def q64_explain(spark, d):
    """The operators of a printed plan and how deep they stand."""
    text = Program(match(Account, PartSpec).has_tag("building").filter(lambda a, p: a.acctbal > 0).foreach(AddPart())).explain()
    rows = [(line.split(":")[0].strip(), (len(line) - len(line.lstrip())) // 2 - 1) for line in text.splitlines()[1:]]
    return spark.createDataFrame(rows, "operator string, depth int")
