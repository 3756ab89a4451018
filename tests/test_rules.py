from pyspark.sql import functions as F

from fieldlake.functions import text as tx
from fieldlake.functions.rules import InstrumentRule, RuleSet, classify_lines, record_timestamp

BC = '"MA200-0001","12",' + ",".join(f'"{i}"' for i in range(9))
SMPS = "1,3/4/2026 1:05:06," + ",".join("0" for _ in range(39))
CASES = [
    ("BC-MA200", BC, True),
    ("BC-MA200", BC.lower(), True),
    ("BC-MA200", '"XX","12",' + ",".join("1" * 9), False),
    ("BC-MA200", '"MA1","12",1,2,3,4,5,6,7,8', False),
    ("BC-MA200", '"MA1","1a",1,2,3,4,5,6,7,8,9', False),
    ("CO2-LICOR", "2026-3-2\t18:0:0\t421.7", True),
    ("CO2-LICOR", "2026-3-2\t18:0\t421.7", False),
    ("CO2-LICOR", "2026-3-2\t18:0:0", False),
    ("NEPH-PM25", "﻿2026/03/02 18:00:00,5.1,44", True),
    ("NEPH-PM25", "2026/03/02 18:00:00,nan,44", True),
    ("NEPH-PM25", "2026/03/02 18:00:00,1d,44", False),
    ("NEPH-PM25", "2026/3/02 18:00:00,1,44", False),
    ("NO2-CAPS", "123456,0,0,8.25,a,b,c,d,e,f", True),
    ("NO2-CAPS", "123456,0,0,8.25,a,b,c,d,e", False),
    ("NO2-CAPS", "% 123456,0,0,8.25,a,b,c,d,e,f", False),
    ("NO2-CAPS", "12345,0,0,8.25,a,b,c,d,e,f", False),
    ("SMPS", SMPS, True),
    ("SMPS", SMPS[:-2], False),
    ("SMPS", SMPS.replace("1:05:06", "1:5:06"), False),
    ("OTHER", "2026-3-2\t18:0:0\t421.7", False),
    ("SMPS", "", False),
    ("SMPS", "," * 60, False),
    ("SMPS", "# x", False),
]


def test_the_five_shapes(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "n int, i string, line string, want boolean")
    rows = classify_lines(df, RuleSet(), instrument="i").orderBy("n").collect()
    assert [r.line for r in rows if r.is_data != r.want] == []


def test_rules_are_data(spark):
    rules = RuleSet([InstrumentRule("A", 2)], default=InstrumentRule("*", 1, patterns={0: "^x"}))
    df = spark.sql("select * from values ('A','1,2'),('A','1'),('A',',,'),('B','xy'),('B','y') t(i, line)")
    got = [r.is_data for r in classify_lines(df, rules, instrument="i").collect()]
    assert got == [True, False, False, True, False]
    assert df.select(rules.valid_instrument(F.col("i")).alias("v")).distinct().count() == 2


TIME_CASES = [
    ("BC-MA200", "Serial,Date / time LOCAL", "s,2026-01-01T00:00:00", "2026-01-01T00:00:00"),
    ("BC-MA200", "Date / time local,Date local (yyyy/MM/dd),Time local (hh:mm:ss)", ",2026/01/02,03:04:05", "2026/01/02 03:04:05"),
    ("BC-MA200", "Date local (yyyy/MM/dd),Time local (hh:mm:ss)", "2026/01/02,", None),
    ("CO2-LICOR", "System_Date_(Y-M-D)\tSystem_Time_(h:m:s)", "2026-1-2\t3:4:5", "2026-1-2 3:4:5"),
    ("CO2-LICOR", "System_Date_(Y-M-D)\tx", "2026-1-2\t3:4:5", None),
    ("NEPH-PM25", "Date_Time,PM", ",1", ""),
    ("NEPH-PM25", "PM,Date_Time", "1", None),
    ("NO2-CAPS", "a,Timestamp,timestamp", "1,old,new", "new"),
    ("SMPS", "n,DateTime Sample Start", "1,3/4/2026 1:05:06", "3/4/2026 1:05:06"),
    ("OTHER", "Timestamp", "x", None),
]


def test_record_timestamp(spark):
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(TIME_CASES)], "n int, i string, h string, line string, want string")
    df = (
        df.withColumn("c", tx.split_fields(F.col("h")))
        .withColumn("p", RuleSet().timestamp_positions(F.col("i"), F.col("c")))
        .withColumn("f", tx.split_fields(F.col("line")))
        .withColumn("got", record_timestamp(F.col("p"), F.col("f")))
    )
    assert [(r.line, r.got) for r in df.orderBy("n").collect()] == [(c[2], c[3]) for c in TIME_CASES]
