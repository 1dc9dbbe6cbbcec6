"""Request and change tables derived from the star-schema tables.

The operators answer requests that people typed; here every stored order, client, line or
mechanic yields a request of its own, so the work grows with the tables. The attribute
groups (order priority, market segment, return flag, region) choose the kind of request:
good ones, misses, repeats, empty lists and null lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.sources import starmap
from wrenchlake.sources.schemas import PART_LINE, PART_REF, PRICE, SERVICE_LINE
from wrenchlake.sources.starmap import padded_phone, priority_digit, star_table

NO_PART = "no such part"
NO_MAKER = "no such maker"
NO_SERVICE = "no such service"
FAR = 1_000_000_000  # added to an id, gives an id that is not stored

SALE_ARRIVAL = ["order_id", "line_no", "part_id", "mechanic_id", "quantity", "amount", "ship_date"]


def _by_digit(**cases: Column) -> Column:
    """One column per priority digit (d1=…, d2=…); a digit left out gives null."""
    chosen = F
    for name, column in cases.items():
        chosen = chosen.when(F.col("d") == int(name[1:]), column)
    return chosen


def _array(kind: str, *items: Column) -> Column:
    return F.array(*items).cast(f"array<{kind}>")


def order_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with one part and one service to ask for, and its priority digit `d`."""
    part = star_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    services = starmap.services(spark, sf_dir).select("service_id", "service_name")
    catalog = part.join(services, F.col("p_type") == F.col("service_name"))
    return (
        star_table(spark, sf_dir, "orders")
        .join(catalog, F.col("o_custkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_custkey").alias("c"),
            priority_digit().alias("d"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.month("o_orderdate").alias("mo"),
            starmap.payment_id().alias("payment_type_id"),
            F.col("p_name").alias("n"),
            F.col("p_brand").alias("m"),
            F.col("service_name").alias("sn"),
            F.col("service_id").alias("s"),
        )
    )


def _picked(spark: SparkSession, sf_dir: str, picks: DataFrame | None) -> DataFrame:
    """The picks as given, by a caller that has written them once for many kinds of requests, or else from the tables."""
    return order_picks(spark, sf_dir) if picks is None else picks


def _int(value: int) -> Column:
    return F.lit(value)


def id_requests(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """(request_id, part_ids, part_qty, service_ids, service_qty): repeats, misses, empty and null lists."""
    c, s, mo = F.col("c"), F.col("s"), F.col("mo")
    return _picked(spark, sf_dir, picks).select(
        "request_id",
        "c",
        "d",
        "order_date",
        "payment_type_id",
        _by_digit(
            d1=_array("bigint", c, c + 1, c),
            d2=_array("bigint", c, c + FAR),
            d3=_array("bigint"),
            d5=_array("bigint", c + 1),
        ).alias("part_ids"),
        _by_digit(
            d1=_array("int", _int(1), _int(2), _int(3)),
            d2=_array("int", _int(4), _int(5)),
            d3=_array("int"),
            d5=_array("int", mo),
        ).alias("part_qty"),
        _by_digit(
            d1=_array("bigint", s),
            d2=_array("bigint", s, s),
            d3=_array("bigint", s),
            d4=_array("bigint"),
            d5=_array("bigint", s, _int(-1)),
        ).alias("service_ids"),
        _by_digit(
            d1=_array("int", _int(1)),
            d2=_array("int", _int(2), _int(3)),
            d3=_array("int", mo),
            d4=_array("int"),
            d5=_array("int", _int(1), _int(1)),
        ).alias("service_qty"),
    )


def name_requests(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """(request_id, parts, service_names) as the lenient quotes take them."""
    ref = PART_REF.simpleString()
    good = F.struct("n", "m")
    sn = F.col("sn")
    return _picked(spark, sf_dir, picks).select(
        "request_id",
        _by_digit(
            d1=_array(ref, good, good),
            d2=_array(ref, good, F.struct(F.lit(NO_PART).alias("n"), "m")),
            d3=_array(ref),
            d4=_array(ref, F.struct("n", F.lit(NO_MAKER).alias("m"))),
        ).alias("parts"),
        _by_digit(
            d1=_array("string", sn),
            d2=_array("string", sn, F.lit(NO_SERVICE)),
            d3=_array("string", sn, sn),
            d4=_array("string"),
            d5=_array("string", F.lit(NO_SERVICE)),
        ).alias("service_names"),
    )


def part_refs(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """(request_id, part_name, manufacturer): one per order, some of them unknown."""
    name = F.when(F.col("d") == 2, F.lit(NO_PART)).otherwise(F.col("n"))
    return _picked(spark, sf_dir, picks).select(
        "request_id", name.alias("part_name"), F.col("m").alias("manufacturer")
    )


def service_refs(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """(request_id, service_name): one per order, some of them unknown."""
    name = F.when(F.col("d") == 5, F.lit(NO_SERVICE)).otherwise(F.col("sn"))
    return _picked(spark, sf_dir, picks).select("request_id", name.alias("service_name"))


def part_order_requests(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """(request_id, order_id, parts): lists that fit, miss, overdraw alone, or overdraw only in sum."""
    line = PART_LINE.simpleString()

    def item(quantity: Column, name: Column | None = None) -> Column:
        return F.struct(F.col("m"), (name if name is not None else F.col("n")).alias("n"), quantity.alias("q"))

    mo = F.col("mo")
    return _picked(spark, sf_dir, picks).select(
        "request_id",
        F.col("request_id").alias("order_id"),
        _by_digit(
            d1=_array(line, item(mo), item(mo + 1)),
            d2=_array(line, item(mo), item(mo, F.lit(NO_PART))),
            d3=_array(line, item(mo * 200)),
            d4=_array(line, item(mo * 60), item(mo * 60)),
        ).alias("parts"),
    )


def service_order_requests(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """(request_id, order_id, mechanic_id, services)."""
    line = SERVICE_LINE.simpleString()

    def item(name: Column, quantity: Column) -> Column:
        return F.struct(name.alias("n"), quantity.alias("q"))

    sn, mo = F.col("sn"), F.col("mo")
    return _picked(spark, sf_dir, picks).select(
        "request_id",
        F.col("request_id").alias("order_id"),
        F.col("c").alias("mechanic_id"),
        _by_digit(
            d1=_array(line, item(sn, mo)),
            d2=_array(line, item(sn, _int(1)), item(F.lit(NO_SERVICE), _int(1))),
            d3=_array(line, item(sn, _int(1)), item(sn, _int(2))),
            d4=_array(line),
        ).alias("services"),
    )


def order_requests(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """Order requests as the order screen sends them; some lack a car, a workplace or a price."""
    requests = id_requests(spark, sf_dir, picks)
    return requests.select(
        "request_id",
        F.col("c").alias("client_id"),
        F.when(F.col("payment_type_id") != 3, F.col("c") * 10 + F.col("d")).alias("car_id"),
        F.col("d").cast("long").alias("workplace_id"),
        "order_date",
        "payment_type_id",
        F.col("c").alias("mechanic_id"),
        "part_ids",
        "part_qty",
        "service_ids",
        "service_qty",
    )


def availability_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, part_id, quantity): every order asks for many pieces of one part, known or not."""
    part = F.when(F.col("d") == 2, F.col("c") + FAR).otherwise(F.col("c"))
    quantity = F.when(F.col("d") != 4, F.col("mo") * 100)
    return order_picks(spark, sf_dir).select("request_id", part.alias("part_id"), quantity.alias("quantity"))


def _as_sale_lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("mechanic_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of part sales with everything that orders their arrival."""
    return _as_sale_lines(star_table(spark, sf_dir, "lineitem"))


def returned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, part_id) of part lines flagged as returned."""
    return (
        star_table(spark, sf_dir, "lineitem")
        .filter((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"))
        .select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"))
    )


def _segment(**cases: Column) -> Column:
    """One column per market segment; a segment left out gives null."""
    chosen = F
    for name, column in cases.items():
        chosen = chosen.when(F.col("c_mktsegment") == name, column)
    return chosen


def _shared(key: Column) -> Column:
    """The same text for two neighbouring keys."""
    return F.lpad(F.shiftright(key, 1).cast("string"), 9, "0")


def phone_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, client_id, new_phone): free, malformed, own, contested numbers, and unknown clients."""
    key = F.col("c_custkey")
    return star_table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", key + FAR).otherwise(key).alias("client_id"),
        _segment(
            AUTOMOBILE=padded_phone(key, "5"),
            BUILDING=F.lit("+799912368"),
            FURNITURE=padded_phone(key, "0"),
            HOUSEHOLD=F.concat(F.lit("+78"), _shared(key)),
            MACHINERY=F.concat(F.lit("+78"), _shared(key)),
        ).alias("new_phone"),
    )


def typed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, role, typed_phone): every client and mechanic types a number into the mask."""

    def masked(phone: Column) -> Column:
        def piece(start: int, length: int) -> Column:
            return F.substring(phone, start, length)

        return F.concat(
            F.lit("+7 ("), piece(3, 3), F.lit(") "), piece(6, 3), F.lit("-"), piece(9, 2), F.lit("-"), piece(11, 2)
        )

    client_typed = masked(padded_phone(F.col("c_custkey"), "0"))
    clients = star_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "mechanic").otherwise("client").alias("role"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.substring(client_typed, 1, 17))
        .otherwise(client_typed)
        .alias("typed_phone"),
    )
    mechanics = star_table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + FAR).alias("request_id"),
        F.lit("mechanic").alias("role"),
        masked(padded_phone(F.col("s_suppkey"), "9")).alias("typed_phone"),
    )
    return clients.unionByName(mechanics)


def client_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, full_name, typed_phone): mechanics, and clients once more, ask to be added as clients."""
    typed = typed_contacts(spark, sf_dir)
    name = F.when(F.col("role") == "mechanic", F.lit("")).otherwise(F.concat(F.lit("New "), F.col("request_id")))
    return typed.select("request_id", name.alias("full_name"), "typed_phone")


def car_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, phone, model, color, license_plate): new, stored, contested and null plates, unknown phones."""
    key = F.col("c_custkey")
    text = key.cast("string")
    known = padded_phone(key, "0")
    return star_table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", padded_phone(key, "3")).otherwise(known).alias("phone"),
        F.col("c_name").alias("model"),
        F.col("c_mktsegment").alias("color"),
        _segment(
            AUTOMOBILE=F.concat(F.lit("N"), text),
            BUILDING=F.concat(F.lit("P"), text, F.lit("1")),
            FURNITURE=F.concat(F.lit("D"), _shared(key)),
            HOUSEHOLD=F.concat(F.lit("D"), _shared(key)),
        ).alias("license_plate"),
    )


def view_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted through the clients-and-cars view, one per order.

    By priority: nothing new; client and car new; a stored plate; one new car number many
    times; many new cars with one plate.
    """
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    d = priority_digit()
    plate_base = F.concat(F.lit("P"), (c * 10 + 1).cast("string"))
    rows = star_table(spark, sf_dir, "orders").select(
        key.alias("request_id"), c.alias("c"), d.alias("d"), "o_orderpriority", plate_base.alias("stored_plate")
    )
    r = F.col("request_id")
    return rows.select(
        "request_id",
        F.when(F.col("d").isin(2, 5), F.col("c") + FAR).otherwise(F.col("c")).alias("client_id"),
        F.concat(F.lit("Owner "), r.cast("string")).alias("full_name"),
        padded_phone(r, "4").alias("phone"),
        _by_digit(
            d1=F.col("c") * 10 + 1,
            d2=r + 1000 * FAR,
            d3=r + 2000 * FAR,
            d4=F.col("c") + 3000 * FAR,
            d5=r + 4000 * FAR,
        ).alias("car_id"),
        F.col("o_orderpriority").alias("model"),
        F.lit("white").alias("color"),
        _by_digit(
            d1=F.col("stored_plate"),
            d2=F.concat(F.lit("V"), r.cast("string")),
            d3=F.col("stored_plate"),
            d4=F.concat(F.lit("W"), F.col("c").cast("string")),
            d5=F.concat(F.lit("Z"), F.col("c").cast("string")),
        ).alias("license_plate"),
    )


def experience_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mechanic_id, experience): by nation the experience grows, stays, falls or becomes unknown."""
    experience = (F.col("s_suppkey") % 40).cast("int")
    nation = F.col("s_nationkey")
    changed = (
        F.when(nation < 8, experience + 1).when(nation < 14, experience).when(nation < 20, experience - 1)
    ).cast("int")
    return star_table(spark, sf_dir, "supplier").filter(nation < 23).select(
        F.col("s_suppkey").alias("mechanic_id"), changed.alias("experience")
    )


def deleted_mechanics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the mechanics of one region."""
    nation = star_table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == 0)
    supplier = star_table(spark, sf_dir, "supplier")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(
        F.col("s_suppkey").alias("mechanic_id")
    )


def order_date_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, seq, order_date): urgent orders move twice, others lose their date or stay."""
    orders = star_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), priority_digit().alias("d"), F.col("o_orderdate").cast("date").alias("day")
    )
    moves = F.when(F.col("d") == 1, F.array(F.date_add("day", 30), F.date_add("day", 7))).when(
        F.col("d") == 2, F.array(F.lit(None).cast("date"))
    )
    return orders.filter(F.col("d") <= 2).select("order_id", F.posexplode(moves).alias("seq", "order_date"))


def client_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op, seq, client_id, full_name, phone): every order edits its client's row or a row of its own."""
    r, c = F.col("request_id"), F.col("c")
    rows = star_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("c"), priority_digit().alias("d")
    )
    op = _by_digit(d1=F.lit("update"), d2=F.lit("delete"), d3=F.lit("insert"), d4=F.lit("update"), d5=F.lit("insert"))
    return rows.select(
        op.alias("op"),
        r.alias("seq"),
        F.when(F.col("d").isin(3, 4), c + FAR).otherwise(c).alias("client_id"),
        F.concat(F.lit("Edit "), r.cast("string")).alias("full_name"),
        padded_phone(r, "6").alias("phone"),
    )


def deliveries(spark: SparkSession, sf_dir: str, picks: DataFrame | None = None) -> DataFrame:
    """(seq, part_id, part_name, manufacturer, price, quantity): every order delivers one part, known or new."""
    new = F.col("d") == 2
    return _picked(spark, sf_dir, picks).select(
        F.col("request_id").alias("seq"),
        F.when(new, F.col("c") + FAR).otherwise(F.col("c")).alias("part_id"),
        F.col("n").alias("part_name"),
        F.col("m").alias("manufacturer"),
        (F.col("mo") * 10).cast(PRICE).alias("price"),
        F.col("mo").alias("quantity"),
    )


def _edit_rows(base: DataFrame, key: str, edits: Column) -> DataFrame:
    """One row per element of the edits; an edit's place in its row's list follows the key in the order."""
    listed = base.select(F.col(key).alias("__key"), F.posexplode(edits).alias("nth", "edit"))
    return listed.select("edit.op", (F.col("__key") * 4 + F.col("nth")).alias("seq"), "edit.row.*")


def _edit(op: str, base: DataFrame, **changed: Column) -> Column:
    """An edit of a row of the table: the row with some columns changed."""
    types = dict(base.dtypes)
    row = F.struct(*[changed.get(c, F.col(c)).cast(types[c]).alias(c) for c in base.columns])
    return F.struct(F.lit(op).alias("op"), row.alias("row"))


def car_edits(spark: SparkSession, sf_dir: str, clash: bool = False) -> DataFrame:
    """Edits of cars by the last digit of the id, which all fit one after another, unless `clash` adds inserts with borne plates.

    1: deleted, and its plate goes to a new car; 2: another plate; 3: deleted and back again; 4: a new car comes and goes;
    5: with `clash`, a new car with the plate of this one.
    """
    cars = starmap.cars(spark, sf_dir)
    key, d = F.col("car_id"), F.col("car_id") % 10
    edits = (
        F.when(d == 1, F.array(_edit("delete", cars), _edit("insert", cars, car_id=key + FAR, model=F.lit("Reborn"))))
        .when(
            d == 2,
            F.array(_edit("update", cars, color=F.lit("red"), license_plate=F.concat(F.lit("E"), key.cast("string")))),
        )
        .when(d == 3, F.array(_edit("delete", cars), _edit("insert", cars, model=F.lit("Back"))))
        .when(
            d == 4,
            F.array(
                _edit("insert", cars, car_id=key + 2 * FAR, license_plate=F.concat(F.lit("F"), key.cast("string"))),
                _edit("delete", cars, car_id=key + 2 * FAR),
            ),
        )
    )
    if clash:
        edits = edits.when(d == 5, F.array(_edit("insert", cars, car_id=key + 3 * FAR)))
    return _edit_rows(cars, "car_id", edits)


def mechanic_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of mechanics by id: gone; another experience and then another salary; no experience; gone, back and promoted; a new colleague."""
    people = starmap.mechanics(spark, sf_dir)
    key, d = F.col("mechanic_id"), F.col("mechanic_id") % 5
    more = F.col("experience") + 1
    edits = (
        F.when(d == 0, F.array(_edit("delete", people)))
        .when(
            d == 1,
            F.array(_edit("update", people, experience=more), _edit("update", people, experience=more, salary=F.lit(5000))),
        )
        .when(d == 2, F.array(_edit("update", people, experience=F.lit(None))))
        .when(
            d == 3,
            F.array(
                _edit("delete", people),
                _edit("insert", people, experience=F.lit(1), salary=F.lit(100)),
                _edit("update", people, experience=F.lit(2), salary=F.lit(100)),
            ),
        )
        .otherwise(F.array(_edit("insert", people, mechanic_id=key + FAR, experience=F.lit(3))))
    )
    return _edit_rows(people, "mechanic_id", edits)


def part_edits(spark: SparkSession, sf_dir: str, clash: bool = False) -> DataFrame:
    """Edits of parts by id: a new part comes and goes; another price; with `clash`, deletes of stored parts."""
    parts = starmap.parts(spark, sf_dir)
    key, d = F.col("part_id"), F.col("part_id") % 3
    far = F.col("part_id") + FAR
    edits = F.when(d == 0, F.array(_edit("insert", parts, part_id=far), _edit("delete", parts, part_id=far))).when(
        d == 1, F.array(_edit("update", parts, price=F.col("price") + 1))
    )
    if clash:
        edits = edits.when((d == 2) & (key % 7 == 3), F.array(_edit("delete", parts)))
    return _edit_rows(parts, "part_id", edits)


def experience_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mechanic_id, seq, experience): every line updates its mechanic's experience; returned ones make it unknown."""
    experience = F.when(F.col("l_returnflag") != "R", F.floor(F.col("l_quantity") / 10).cast("int"))
    return star_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("mechanic_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        experience.alias("experience"),
    )


def car_requests_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As car_requests, with ids: none, often a stored one, or one that a neighbour asks for too."""
    key = F.col("request_id")
    car_id = F.when(key % 4 == 1, key * 10 + 1).when(key % 4 >= 2, F.shiftright(key, 1) + 5 * FAR)
    return car_requests(spark, sf_dir).withColumn("car_id", car_id)


def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, first_day, last_day): per order the month before it, its day, no days, an open range, the year after it."""
    rows = star_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("date").alias("day"), priority_digit().alias("d")
    )
    day = F.col("day")
    return rows.select(
        "request_id",
        _by_digit(d1=F.date_sub(day, 30), d2=day, d3=day, d5=day).alias("first_day"),
        _by_digit(d1=day, d2=day, d3=F.date_sub(day, 1), d4=day, d5=F.date_add(day, 365)).alias("last_day"),
    )


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, text): per client two digits between blanks, three digits, wildcards, a miss or a short text, and rarely nothing at all."""
    key = F.col("c_custkey")
    two = F.lpad((key % 100).cast("string"), 2, "0")
    text = _segment(
        AUTOMOBILE=F.concat(F.lit("  "), two, F.lit(" ")),
        BUILDING=F.lpad((key % 1000).cast("string"), 3, "0"),
        FURNITURE=F.concat(F.lit("r#%0_"), (key % 10).cast("string")),
        HOUSEHOLD=F.concat(F.lit("no "), two),
        MACHINERY=F.when(key % 50 == 0, F.lit("")).otherwise((key % 10).cast("string")),
    )
    return star_table(spark, sf_dir, "customer").select(key.alias("request_id"), text.alias("text"))
