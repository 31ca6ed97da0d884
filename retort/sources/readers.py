"""Readers of molecule encodings: SMILES, our own binary form, SDF records, or whichever fits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.chem.mol import NUMBER, Atom, Bond, Mol, MolError, sanitize
from retort.chem.smiles import merge_hydrogens, parse_smiles

_MAGIC = b"RM1"


def to_binary(m: Mol) -> bytes:
    atoms = [[a.z, a.charge, a.isotope, a.n_h, int(a.aromatic), a.chiral, a.amap, int(a.no_implicit), list(a.order)] for a in m.atoms]
    return _MAGIC + json.dumps([atoms, [[b.a, b.b, b.order, int(b.aromatic)] for b in m.bonds], m.props], separators=(",", ":")).encode()


def from_binary(data: bytes | None) -> Mol:
    if not isinstance(data, (bytes, bytearray)) or not data.startswith(_MAGIC):
        raise MolError("not a binary molecule")
    try:
        atoms, bonds, props = json.loads(bytes(data[len(_MAGIC) :]))
        m = Mol([Atom(z, q, i, h, bool(ar), c, am, bool(no), tuple(o)) for z, q, i, h, ar, c, am, no, o in atoms], [Bond(a, b, o, bool(ar)) for a, b, o, ar in bonds], props)
    except (ValueError, TypeError) as e:
        raise MolError("damaged binary molecule") from e
    return m


def from_sdf(text: str | bytes | None, identifier: str = "smiles") -> Mol:
    """The first record of an SDF text (V2000), with its properties."""
    from retort.chem.smiles import to_smiles

    if isinstance(text, (bytes, bytearray)):
        text = bytes(text).decode("utf-8", "replace")
    if not isinstance(text, str):
        raise MolError("not an SDF text")
    lines = text.split("$$$$")[0].split("\n")
    try:
        n_atoms, n_bonds = int(lines[3][0:3]), int(lines[3][3:6])
        m = Mol()
        for line in lines[4 : 4 + n_atoms]:
            m.atoms.append(Atom(NUMBER[line[31:34].strip()]))
        for line in lines[4 + n_atoms : 4 + n_atoms + n_bonds]:
            a, b, o = int(line[0:3]) - 1, int(line[3:6]) - 1, int(line[6:9])
            m.bonds.append(Bond(a, b, 1 if o == 4 else o, o == 4))
            if o == 4:
                m.atoms[a].aromatic = m.atoms[b].aromatic = True
        rest = lines[4 + n_atoms + n_bonds :]
        for line in rest:
            if line.startswith(("M  CHG", "M  ISO")):
                v = [int(x) for x in line[9:].split()]
                for i, q in zip(v[::2], v[1::2]):
                    setattr(m.atoms[i - 1], "charge" if line[3:6] == "CHG" else "isotope", q)
            if line.startswith("M  END"):
                break
    except (IndexError, ValueError, KeyError) as e:
        raise MolError("not an SDF record") from e
    for i, line in enumerate(rest):
        if line.startswith(">") and "<" in line:
            m.props[line[line.index("<") + 1 : line.rindex(">")]] = rest[i + 1].strip() if i + 1 < len(rest) else ""
    m = merge_hydrogens(sanitize(m))
    m.props["identifier"] = to_smiles(m) if identifier == "smiles" else lines[0].strip()
    return m


def from_smiles(text, remove_hydrogens: bool = True) -> Mol:
    if not isinstance(text, str):
        raise MolError("not a SMILES text" if text is not None else "no input")
    return parse_smiles(text, remove_hydrogens)


READERS = {"smiles": from_smiles, "binary": from_binary, "sdf": from_sdf}


def from_any(value, order: tuple[str, ...] = ("smiles", "binary", "sdf")) -> Mol:
    """The first reader that takes the value."""
    for name in order:
        try:
            return READERS[name](value)
        except MolError:
            continue
    raise MolError("no reader takes the input")


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: row_id, input. Records are split by the source, so a large file is read by many tasks."""
    d = spark.read.option("lineSep", "$$$$\n").text(path).where(F.trim("value") != "")
    return d.select(F.monotonically_increasing_id().alias("row_id"), F.col("value").alias("input"))


def read_table(spark: SparkSession, path: str, column: str, sep: str = "\t") -> DataFrame:
    """A CSV or TSV file with a header: row_id, input and the other columns."""
    d = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    return d.withColumnRenamed(column, "input").withColumn("row_id", F.monotonically_increasing_id())


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: row_id, input (binary), path."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("row_id"), F.col("content").alias("input"), "path")


def load_url(url: str, timeout: float = 60.0) -> bytes:
    """The bytes at a URL, fetched by the driver; a bad status raises."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:  # raises HTTPError beyond status 299
        return r.read()
