"""The system table of types."""

from __future__ import annotations

from brightwell.types import BIT, INT, SMALLINT, SYSNAME, TINYINT, VARCHAR, SqlType

COLLATION, COLLATION_ID = "SQL_Latin1_General_CP1_CI_AS", 872468488

COLUMNS: list[tuple[str, SqlType, bool]] = [
    ("name", SYSNAME, False),
    ("xtype", TINYINT, False),
    ("status", TINYINT, True),
    ("xusertype", SMALLINT, True),
    ("length", SMALLINT, False),
    ("xprec", TINYINT, False),
    ("xscale", TINYINT, False),
    ("tdefault", INT, False),
    ("domain", INT, False),
    ("uid", SMALLINT, True),
    ("reserved", SMALLINT, True),
    ("collationid", INT, True),
    ("usertype", SMALLINT, True),
    ("variable", BIT, False),
    ("allownulls", BIT, True),
    ("type", TINYINT, False),
    ("printfmt", VARCHAR, True),
    ("prec", SMALLINT, True),
    ("scale", TINYINT, True),
    ("collation", SYSNAME, True),
]

#: Name, xtype, xusertype, length, xprec, xscale, usertype, type, prec, scale.
_TYPES = """
image             34  34    16  0  0 20  34     -  -
text              35  35    16  0  0 19  35     -  -
uniqueidentifier  36  36    16  0  0  0  37    16  -
date              40  40     3 10  0  0   0    10  0
time              41  41     5 16  7  0   0    16  7
datetime2         42  42     8 27  7  0   0    27  7
datetimeoffset    43  43    10 34  7  0   0    34  7
tinyint           48  48     1  3  0  5  48     3  0
smallint          52  52     2  5  0  6  52     5  0
int               56  56     4 10  0  7  56    10  0
smalldatetime     58  58     4 16  0 22  58    16  0
real              59  59     4 24  0 23  59    24  -
money             60  60     8 19  4 11  60    19  4
datetime          61  61     8 23  3 12  61    23  3
float             62  62     8 53  0  8  62    53  -
sql_variant       98  98  8016  0  0  0  39     0  -
ntext             99  99    16  0  0  0  35     -  -
bit              104 104     1  1  0 16  50     1  -
decimal          106 106    17 38 38 24  55    38 38
numeric          108 108    17 38 38 10  63    38 38
smallmoney       122 122     4 10  4 21 122    10  4
bigint           127 127     8 19  0  0  63    19  0
hierarchyid      240 128   892  0  0  0   0   892  -
geometry         240 129    -1  0  0  0   0    -1  -
geography        240 130    -1  0  0  0   0    -1  -
varbinary        165 165  8000  0  0  4  37  8000  -
varchar          167 167  8000  0  0  2  39  8000  -
binary           173 173  8000  0  0  3  45  8000  -
char             175 175  8000  0  0  1  47  8000  -
timestamp        189 189     8  0  0 80  45     8  -
nvarchar         231 231  8000  0  0  0  39  4000  -
nchar            239 239  8000  0  0  0  47  4000  -
xml              241 241    -1  0  0  0   0    -1  -
sysname          231 256   256  0  0 18  39   128  -
"""
_COLLATED = {"text", "ntext", "varchar", "char", "nvarchar", "nchar", "sysname"}
_VARIABLE = {"varbinary", "varchar", "nvarchar", "sysname"}
_MARKED, _NOT_NULL = {"timestamp", "sysname"}, {"timestamp", "sysname"}


def rows() -> list[tuple]:
    out = []
    for line in _TYPES.split("\n"):
        if line:
            name, *numbers = line.split()
            xtype, xusertype, length, xprec, xscale, usertype, kind, prec, scale = (None if n == "-" else int(n) for n in numbers)
            collated = name in _COLLATED
            out.append((name, xtype, int(name in _MARKED), xusertype, length, xprec, xscale, 0, 0, 4, 0, COLLATION_ID if collated else None, usertype, name in _VARIABLE, name not in _NOT_NULL, kind, None, prec, scale, COLLATION if collated else None))
    return out
