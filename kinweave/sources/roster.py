"""Disagreeing rosters made from the customer table by a keyed hash.

One SQL text serves any engine: only the hash macro differs. Four views of each
entity, each with its own kinds of damage, and a later batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = "James,Robert,Elizabeth,Margaret,William,Katherine,Thomas,Susan,Daniel,Ana,Michael,Patricia,Wei,Omar,Deborah,Joseph,Mary Ann"
FAMILY = "Ashcraft,Schneider,Okafor,OBrien,Whitaker,Lindqvist,Martinez,Hughes,Kowalski,Nguyen,Abernathy,Dickson,Dixon,Fischer,Mbeki,Stewart,Chowdhury,Ruiz,Thwaite,Washburn,Vance,Yamada,Petrov,Larsen,Quigley,Haddad,Ibarra,Jensen,Moreau,Zhang"
ROADS = "Maple Street,Oak Avenue,Cedar Road,Elm Boulevard,Lake Drive,Hill Lane,Park Place,Mill Court,Sunset Parkway,North Ridge Terrace"
CITIES = "Dover,Salem,Austin,Boise,Macon,Reno,Tulsa,Utica"
STATES = "DE,OR,TX,ID,GA,NV,OK,NY"
FIELDS = "cardiology,pediatrics,oncology,radiology,neurology"

_HASH = {
    "spark": "cast(conv(substr(md5(concat_ws('|', cast(c_custkey as string), '{k}')), 1, 8), 16, 10) as bigint)",
    "duckdb": "cast(('0x' || substr(md5(concat_ws('|', cast(c_custkey as varchar), '{k}')), 1, 8)) as bigint)",
}


def _entity_sql(engine: str, customers: str) -> str:
    """SELECT text of the entities themselves."""
    h = lambda k: _HASH[engine].replace("{k}", k)
    pick = lambda pool, k: f"split_part('{pool}', ',', cast({h(k)} % {pool.count(',') + 1} + 1 as int))"
    text = "string" if engine == "spark" else "varchar"
    return f"""select c_custkey as entity_id, {pick(GIVEN, 'given')} as given, {pick(FAMILY, 'family')} as family,
      cast(1000000000 + (cast(c_custkey as bigint) * 7919) % 899999981 as {text}) as npi, cast({h('no')} % 900 + 100 as {text}) as house,
      {pick(ROADS, 'road')} as road, cast({h('suite')} % 40 + 1 as {text}) as room, {pick(CITIES, 'city')} as city, {pick(STATES, 'city')} as state,
      cast(10000 + {h('zip')} % 900 as {text}) as zip5, concat('2', substr(cast(1000000000 + {h('phone')} % 900000000 as {text}), 2, 9)) as phone10,
      {pick(FIELDS, 'field')} as specialty, {', '.join(f"{h(f'u{i}')} % 100 as u{i}" for i in range(12))} from {customers}"""


def truth_sql(engine: str, customers: str = "customer") -> str:
    """SELECT text of the true value of every golden field, a row an entity."""
    return f"""select entity_id as entity, npi, upper(given) as given, upper(family) as family, case when u4 < 50 then 'MD' else 'PHD' end as credential, upper(concat(house, ' ', road)) as street,
      concat('SUITE ', room) as suite, upper(city) as city, state, zip5 as zip, phone10 as phone, specialty, case when u10 < 70 then 'IN' else 'OUT' end as network_status from ({_entity_sql(engine, customers)}) e"""


def roster_sql(engine: str, customers: str = "customer") -> str:
    """SELECT text of all source rows with their entity (the truth)."""
    text = "string" if engine == "spark" else "varchar"
    entity = _entity_sql(engine, customers)
    wide = "concat('(', substr(phone10, 1, 3), ') ', substr(phone10, 4, 3), '-', substr(phone10, 7, 4))"
    dots = "concat('1.', substr(phone10, 1, 3), '.', substr(phone10, 4, 3), '.', substr(phone10, 7, 4))"
    none = f"cast(null as {text})"
    day = lambda base, u: f"concat('2024-{base}-', lpad(cast({u} % 28 + 1 as {text}), 2, '0'))"
    columns = "source_system, source_row_id, entity_id, ingest_batch, observed_at, npi, name_raw, street, suite, city, state, zip, phone, specialty, multi, moved, network_status"

    def view(source: str, offset: int, keep: str, batch: str, seen: str, npi: str, name: str, street: str, suite: str, zipcode: str, phone: str, multi: str) -> str:
        return f"""select '{source}' as source_system, cast(entity_id + {offset} as int) as source_row_id, entity_id, {batch} as ingest_batch, {seen} as observed_at,
          {npi} as npi, {name} as name_raw, {street} as street, {suite} as suite, city, state, {zipcode} as zip, {phone} as phone, specialty, {multi} as multi, u11 < 8 as moved,
          {"case when u10 < 70 then 'IN' else 'OUT' end" if source == 'payer_feed' else none} as network_status from entity where {keep}"""

    batch = "case when u9 < 90 then 1 else 2 end"
    full = "concat(house, ' ', road)"
    views = [
        view("payer_feed", 0, "u0 < 95", batch, day("03", "u1"), f"case when u2 < 80 then npi else {none} end", "concat(upper(family), ', ', given, case when u3 < 30 then ', M.D.' else '' end)", full, "concat('Ste. ', room)", "concat(zip5, '-0001')", wide, "false"),
        view("payer_feed", 50000000, "u4 < 15", "1", day("03", "u5"), f"case when u2 < 80 then npi else {none} end", "concat(upper(family), ', ', given)", "concat('7', house, ' Bay Street')", none, "zip5", wide, "false"),
        view("license_board", 0, "u1 < 90", batch, day("01", "u2"), "concat('NPI ', npi)", "concat(given, ' Q ', family, case when u4 < 50 then ', MD' else ' PhD' end)", none, none, "zip5", none, "false"),
        view("site_scrape", 0, "u2 < 80", batch, day("05", "u3"), f"case when u5 < 20 then npi else {none} end", "case when u6 < 8 then concat('Dr. ', given, ' ', family, ' and Pat Smith') else concat('Dr. ', given, ' ', family) end", "concat(house, ' ', replace(replace(replace(road, 'Street', 'St'), 'Avenue', 'Ave.'), 'Parkway', 'Pkwy'), case when u10 < 30 then ' # ' when u10 < 45 then ' Ste. 4-' else ' Suite ' end, room)", none, "zip5", dots, "u6 < 8"),
        view("clearinghouse", 0, "u3 < 92", batch, day("06", "u4"), "npi", "concat(case when u7 < 25 then replace(replace(replace(given, 'Robert', 'Bob'), 'Elizabeth', 'Liz'), 'William', 'Bill') else given end, ' ', case when u8 < 12 then concat(substr(family, 1, 2), substr(family, 4)) else family end)", full, "concat('#', room)", "case when u8 < 5 then '99' else zip5 end", f"case when u7 < 10 then '555' else {wide} end", "false"),
        # a mover's later row, from the new address
        view("clearinghouse", 60000000, "u11 < 8", "2", day("08", "u4"), "npi", "concat(given, ' ', family)", "concat('9', house, ' Harbor Road')", none, "zip5", wide, "false"),
    ]
    return f"with entity as ({entity}) " + " union all ".join(f"select {columns} from ({v}) v" for v in views)


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("kinweave_customer")
    return spark.sql(roster_sql("spark", "kinweave_customer"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("kinweave_customer")
    return spark.sql(truth_sql("spark", "kinweave_customer"))
