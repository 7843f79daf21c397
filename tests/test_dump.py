"""SQL dumps: any cut of the bytes gives the same rows."""

import random
from collections import Counter

import pytest

from marlstone.sources import dump

TEXT = """-- it's a comment; with 'quotes
/*!40101 SET NAMES utf8; ' */;
DROP TABLE IF EXISTS `t;x`;
INSERT INTO `t` VALUES (1,'a;b\\'c;''d',NULL),(2,'line
break; -- no comment','x\\\\');
INSERT INTO other VALUES (9,'t',';');/**/;/***;**/
INSERT INTO db.`t` (`c`, id) VALUES ('/* no; comment','3'), (X'C3A9', 4);
insert into T (id, b) values (-5 , 'école; "世界'), (6, ''),(7,'0\\0\\n\\t');
INSERT INTO t VALUES (8, '--', '-- ;');-- end; 'open
INSERT INTO t VALUES (9,'last','')"""
ROWS = [
    ("1", "a;b'c;'d", None), ("2", "line\nbreak; -- no comment", "x\\"), ("3", None, "/* no; comment"), ("4", None, "é"),
    ("-5", 'école; "世界', None), ("6", "", None), ("7", "0\0\n\t", None), ("8", "--", "-- ;"), ("9", "last", ""),
]


def in_parts(path, data, cuts, block=1 << 20):
    """What read() does, without Spark: ends of states chained, then each part's statements."""
    state, out = 0, []
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        for statement in dump.statements(dump.Part(str(path), a, b, state), block=block):
            out += dump.rows_of(statement, "t", ["id", "b", "c"])
        state = dump.end_states(data[a:b])[state]
    return out


def test_every_cut(tmp_path):
    data, path = TEXT.encode(), tmp_path / "d.sql"
    path.write_bytes(data)
    assert in_parts(path, data, []) == ROWS
    for cut in range(1, len(data)):
        assert in_parts(path, data, [cut]) == ROWS, cut
    r = random.Random(3)
    for n in (2, 5, 16, 60):
        assert in_parts(path, data, sorted(r.sample(range(1, len(data)), n)), block=r.choice([1, 7, 50])) == ROWS
    assert in_parts(path, data, range(1, len(data))) == ROWS


def test_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.sql").write_text(TEXT)
    (tmp_path / "d" / "b.sql").write_text("INSERT INTO t VALUES (1,'a',NULL);")
    (tmp_path / "d" / "_SUCCESS").write_text("")
    (tmp_path / "d" / "empty.sql").write_text("")
    want = Counter([*((int(a), b, c) for a, b, c in ROWS), (1, "a", None)])
    for split in (1 << 20, len(TEXT.encode()) // 16 + 1):
        got = dump.read(spark, str(tmp_path / "d"), "t", "id int, b string, c string", split)
        assert Counter(map(tuple, got.collect())) == want
    assert dump.read(spark, str(tmp_path / "d"), "absent", "id int").count() == 0
    assert dump.read(spark, str(tmp_path / "d" / "empty.sql"), "t", "id int").count() == 0
    with pytest.raises(FileNotFoundError):
        dump.read(spark, str(tmp_path / "none"), "t", "id int")
    with pytest.raises(Exception, match="values for 2 columns"):
        dump.read(spark, str(tmp_path / "d" / "b.sql"), "t", "id int, b string").count()


def test_doubled_quotes_only(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO t VALUES ('a\\'),('b''c;\\');\nINSERT INTO t VALUES ('d');")
    for split in (1 << 20, 5):
        got = dump.read(spark, str(tmp_path / "d.sql"), "t", "v string", split, backslash=False)
        assert sorted(r.v for r in got.collect()) == ["a\\", "b'c;\\", "d"]


def test_written_and_read(spark, tmp_path):
    """Rows of any kind, repeated ones too, from several files in ranges of any size."""
    r = random.Random(5)
    rows = [(r.choice([None, i]), r.choice([None, "".join(r.choice("a';\\\n\r\t-/*\"`é世") for _ in range(r.randrange(60)))]), r.choice([None, r.random()]), r.choice([None, True])) for i in range(500)]
    df = spark.createDataFrame([*rows, *rows[:20]], "id long, `a b` string, x double, y boolean").repartition(3)
    dump.write(df, str(tmp_path / "d"), "t", rows=7)
    for split in (1 << 20, 4000):
        got = dump.read(spark, str(tmp_path / "d"), "t", df.schema, split)
        assert Counter(map(tuple, got.collect())) == Counter([*rows, *rows[:20]])
    dump.write(df.limit(0), str(tmp_path / "none"), "t")
    assert dump.read(spark, str(tmp_path / "none"), "t", df.schema).count() == 0
