"""A plan: reader, molecule steps and filters, outputs. All of it runs in one Arrow pass; errors are values of the err column.

Plans are immutable, go to JSON and back through the registry of operators below (no code is imported by name), and can be taken apart.
"""

from __future__ import annotations

import functools
import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.chem import features as X
from retort.chem import standardize as S
from retort.chem.mol import SYMBOLS, Mol, MolError
from retort.chem.reaction import canonical_tautomer, react
from retort.chem.smiles import parse_smarts, parse_smiles, pattern_of, to_smiles
from retort.plans.errors import ERR
from retort.sources import readers

#: Results that a task keeps for inputs that come again.
CACHED = 4096
#: Allowed elements of the element filter by default; fixed values.
DEFAULT_ELEMENTS = (1, 5, 6, 7, 8, 9, 14, 15, 16, 17, 34, 35, 53)


#: Inputs of fewer bytes a core than this are dealt over all cores.
SPREAD_BYTES = 16 << 20


def dense(col: str | Column, n: int) -> Column:
    """A map position -> value as an array of n doubles."""
    m = F.col(col) if isinstance(col, str) else col
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double"))


def sparse(col: str | Column) -> Column:
    """An array as a map position -> value, without zeros."""
    a = F.col(col) if isinstance(col, str) else col
    pairs = F.transform(a, lambda v, i: F.struct(i.alias("i"), v.cast("int").alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"] != 0))


def _estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def as_range(v) -> tuple[float | None, float | None]:
    """A number n is (n, n); a pair keeps its open ends."""
    return (v, v) if isinstance(v, (int, float)) else (v[0], v[1])


def within(r: tuple[float | None, float | None], v: float) -> bool:
    return (r[0] is None or v >= r[0]) and (r[1] is None or v <= r[1])


def decide(hits: Iterator[bool], keep_matches: bool, mode: str) -> bool:
    """any/keep: one in range; any/drop: none; all/keep: every one; all/drop: not every one."""
    if mode not in ("any", "all"):
        raise ValueError("mode must be 'any' or 'all'")
    return (any(hits) if mode == "any" else all(hits)) == keep_matches


def _ranges(patterns) -> dict[str, tuple]:
    return {p: as_range(v) for p, v in patterns.items()} if isinstance(patterns, dict) else {p: (1, None) for p in patterns}


def _keep(test: Callable[[Mol], bool], message: str) -> Callable[[Mol], Mol]:
    def run(m: Mol) -> Mol:
        if not test(m):
            raise MolError(message)
        return m

    return run


def _element_filter(allowed=None, add_hydrogens: bool = True):
    ranges = {int(z): as_range(r) for z, r in allowed.items()} if isinstance(allowed, dict) else dict.fromkeys(map(int, allowed or DEFAULT_ELEMENTS), (None, None))
    count_h = add_hydrogens and 1 in ranges

    def test(m: Mol) -> bool:
        seen = {a.z for a in m.atoms} | ({1} if count_h and X.n_hydrogens(m) else set())
        if not seen <= set(ranges):
            return False
        counts = {z: (X.n_hydrogens(m) if count_h else sum(a.z == 1 for a in m.atoms)) if z == 1 else sum(a.z == z for a in m.atoms) for z in ranges}
        return all(within(r, counts[z]) for z, r in ranges.items())

    return _keep(test, "forbidden element or element count")


def _pattern_filter(compile_: Callable):
    def make(patterns, keep_matches: bool = True, mode: str = "any"):
        try:
            compiled = [(compile_(p), r) for p, r in _ranges(patterns).items()]
        except MolError as e:
            raise ValueError(f"bad pattern: {e}") from e
        decide(iter(()), keep_matches, mode)
        return _keep(lambda m: decide((within(r, len(p.matches(m))) for p, r in compiled), keep_matches, mode), "pattern filter")

    return make


def _descriptor_filter(ranges: dict, keep_matches: bool = True, mode: str = "any"):
    X.check_descriptors(list(ranges))
    decide(iter(()), keep_matches, mode)
    rs = {n: as_range(r) for n, r in ranges.items()}

    def test(m: Mol) -> bool:
        values = dict(zip(rs, X.descriptors(m, list(rs))))
        return decide((values[n] is not None and within(r, values[n]) for n, r in rs.items()), keep_matches, mode)

    return _keep(test, "descriptor out of range")


def _complex_filter(filters: dict, keep_matches: bool = True, mode: str = "any"):
    """filters: name -> [op, params]; a filter that passes counts one."""
    built = [MOL_OPS[op](**params) for op, params in filters.values()]
    decide(iter(()), keep_matches, mode)

    def passes(f, m: Mol) -> bool:
        try:
            f(m)
            return True
        except MolError:
            return False

    return _keep(lambda m: decide((passes(f, m) for f in built), keep_matches, mode), "combined filter")


def _inorganic(m: Mol) -> bool:
    if not any(a.z == 6 for a in m.atoms):
        return True
    return len(m.atoms) <= 3 and to_smiles(m) in ("O=C=O", "[C-]#[O+]")


def _step(name: str):
    return lambda **kw: (lambda m: S.STEPS[name](m, **{k: tuple(v) if isinstance(v, list) else v for k, v in kw.items()}))


#: Molecule to molecule.
MOL_OPS: dict[str, Callable] = {n: _step(n) for n in S.STEPS} | {
    "canonical_tautomer": lambda most=2000: lambda m: canonical_tautomer(m, most),
    "reaction": lambda reaction, additives=(), handle_multi="warn": lambda m: react(m, reaction, list(additives), handle_multi),
    "passthrough": lambda: lambda m: m, "element_filter": _element_filter, "smarts_filter": _pattern_filter(parse_smarts), "smiles_filter": _pattern_filter(lambda s: pattern_of(parse_smiles(s))),
    "descriptor_filter": _descriptor_filter, "complex_filter": _complex_filter, "mixture_filter": lambda: _keep(lambda m: len(m.fragments()) <= 1, "more than one fragment"),
    "custom_filter": lambda test, message="custom filter": _keep(test, message),
    "empty_filter": lambda: _keep(lambda m: bool(m.atoms), "no atoms"), "inorganics_filter": lambda: _keep(lambda m: not _inorganic(m), "inorganic"),
}


def _vector(f: Callable[[Mol], list]):
    def run(m: Mol) -> list[float]:
        out = f(m)
        if any(v is None for v in out):
            raise MolError("a descriptor has no value")
        return [float(v) for v in out]

    return run


def _descriptors(names=None, return_with_errors: bool = False):
    names = X.check_descriptors(list(names if names is not None else X.DESCRIPTORS))
    return (lambda m: [float("nan") if v is None else v for v in X.descriptors(m, names)]) if return_with_errors else _vector(lambda m: X.descriptors(m, names))


def _dense(kind: str, n_bits: int = 2048, **kw):
    f = {"morgan": X.morgan, "path": X.path_fingerprint}[kind]

    def run(m: Mol) -> list[float]:
        out = [0.0] * n_bits
        for b, v in f(m, n_bits=n_bits, **kw).items():
            out[b] = float(v)
        return out

    return run


def _concat(parts: list):
    if not parts:
        raise ValueError("nothing to put together")
    built = [(_dense(op, **kw) if op in ("morgan", "path") else OUTPUTS[op][1](**kw)) for op, kw in parts]
    return lambda m: [float(v) for f in built for v in (lambda x: x if isinstance(x, list) else [x])(f(m))]


def _element_count(numbers=None):
    numbers = list(numbers or range(1, 119))
    X.element_counts(Mol(), numbers)
    return _vector(lambda m: X.element_counts(m, numbers))


def _net_charge(method: str = "formal"):
    """formal, or gasteiger: the rounded sum of partial charges."""
    if method not in ("formal", "gasteiger"):
        raise ValueError("method must be 'formal' or 'gasteiger'")
    return (lambda m: float(sum(a.charge for a in m.atoms))) if method == "formal" else (lambda m: float(round(sum(X.gasteiger_charges(m)))))


def _morgan(radius: int = 2, n_bits: int = 2048, counted: bool = False, use_features: bool = False):
    X.morgan(Mol(), radius, n_bits)
    return lambda m: list(X.morgan(m, radius, n_bits, counted, use_features).items())


def _morgan_atoms(radius: int = 2, n_bits: int = 2048):
    """By bit its environments: what each atom has to do with a fingerprint."""
    return lambda m: [{"bit": b, "atoms": atoms} for b, envs in X.morgan_atoms(m, radius, n_bits).items() for _, _, atoms in envs]


#: Output name -> (Spark type, factory of Mol -> value).
OUTPUTS: dict[str, tuple[str, Callable]] = {
    "smiles": ("string", lambda: to_smiles), "binary": ("binary", lambda: readers.to_binary), "bool": ("boolean", lambda: lambda m: True),
    "morgan": ("map<int,int>", _morgan), "morgan_atoms": ("array<struct<bit:int,atoms:array<int>>>", _morgan_atoms), "path": ("map<int,int>", lambda **kw: lambda m: list(X.path_fingerprint(m, **kw).items())),
    "morgan_bits": ("array<int>", lambda radius=2, n_bits=2048: lambda m: list(X.morgan(m, radius, n_bits))),
    "descriptors": ("array<double>", _descriptors), "element_count": ("array<double>", _element_count), "net_charge": ("double", _net_charge), "pattern_keys": ("map<int,int>", lambda keys: lambda m: list(X.pattern_keys(m, keys).items())),
    "pharmacophore": ("map<int,int>", lambda **kw: lambda m: list(X.pharmacophore(m, **kw).items())), "graph": ("string", lambda: lambda m: json.dumps(X.graph_features(m), separators=(",", ":"))),
    "fragments": ("int", lambda: lambda m: len(m.fragments())), "concat": ("array<double>", _concat), "scaffold": ("string", lambda: lambda m: to_smiles(S.murcko(m))),
    "n_atoms": ("int", lambda: lambda m: len(m.atoms)),
}
_ARROW = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "map<int,int>": pa.map_(pa.int32(), pa.int32()), "array<struct<bit:int,atoms:array<int>>>": pa.list_(pa.struct([("bit", pa.int32()), ("atoms", pa.list_(pa.int32()))])), "array<int>": pa.list_(pa.int32()),
          "array<double>": pa.list_(pa.float64()), "double": pa.float64(), "int": pa.int32()}
_ERR_ARROW = pa.struct([("element_id", pa.string()), ("element_name", pa.string()), ("message", pa.string())])


def _names(op: str, kw: dict) -> list[str]:
    if op == "descriptors":
        return list(kw.get("names") or X.DESCRIPTORS)
    if op == "element_count":
        return [f"Count_{SYMBOLS[z]}" for z in kw.get("numbers") or range(1, 119)]
    if op in ("morgan", "path"):
        return [f"{op}_{i}" for i in range(kw.get("n_bits", 2048))]
    if op == "concat":
        out = [f"{p}__{n}" for p, k in kw["parts"] for n in _names(p, k)]
        if len(set(out)) < len(out):
            warnings.warn("feature names are not unique", stacklevel=3)
        return out
    return [op]


_OWN_STEPS: set[str] = set()
_OWN_OUTPUTS: set[str] = set()


def register_step(name: str, factory: Callable[..., Callable[[Mol], Mol]]) -> None:
    """A step of the user's own: factory(**params) gives molecule -> molecule, which raises MolError to reject. Plans with it go to JSON."""
    if name in MOL_OPS and name not in _OWN_STEPS:
        raise ValueError(f"{name!r} is a step already")
    MOL_OPS[name] = factory
    _OWN_STEPS.add(name)


def register_output(name: str, spark_type: str, factory: Callable[..., Callable[[Mol], object]]) -> None:
    """An output of the user's own, of one of the types in use."""
    if name in OUTPUTS and name not in _OWN_OUTPUTS:
        raise ValueError(f"{name!r} is an output already")
    if spark_type not in _ARROW:
        raise ValueError(f"unknown type {spark_type!r}; known: {sorted(_ARROW)}")
    OUTPUTS[name] = (spark_type, factory)
    _OWN_OUTPUTS.add(name)


@dataclass(frozen=True)
class Step:
    name: str
    op: str
    params: tuple = ()  # sorted (key, value) pairs

    @staticmethod
    def of(name: str, op: str, **params) -> Step:
        return Step(name, op, tuple(sorted(params.items())))

    @property
    def kwargs(self) -> dict:
        return dict(self.params)


@dataclass(frozen=True)
class Plan:
    reader: Step
    steps: tuple[Step, ...] = ()
    outputs: tuple[Step, ...] = ()

    def __post_init__(self):
        names = [s.name for s in (self.reader, *self.steps, *self.outputs)]
        if len(set(names)) < len(names):
            raise ValueError("step names must differ")
        self._build()

    def _build(self):
        if self.reader.op not in (*readers.READERS, "auto"):
            raise ValueError(f"unknown reader {self.reader.op!r}")
        read = readers.from_any if self.reader.op == "auto" else readers.READERS[self.reader.op]
        kw = {k: tuple(v) if isinstance(v, list) else v for k, v in self.reader.kwargs.items()}
        for s in self.steps:
            if s.op not in MOL_OPS:
                raise ValueError(f"unknown step {s.op!r}")
        for s in self.outputs:
            if s.op not in OUTPUTS:
                raise ValueError(f"unknown output {s.op!r}")
        return (lambda v: read(v, **kw)), [(s, MOL_OPS[s.op](**s.kwargs)) for s in self.steps if s.op != "passthrough"], [(s, OUTPUTS[s.op][1](**s.kwargs)) for s in self.outputs]

    def with_params(self, **params) -> Plan:
        """name__key=value; an unknown name raises."""
        parts = {s.name: s for s in (self.reader, *self.steps, *self.outputs)}
        for key, v in params.items():
            name, _, k = key.partition("__")
            if name not in parts or not k:
                raise ValueError(f"unknown parameter {key!r}")
            parts[name] = Step.of(name, parts[name].op, **(parts[name].kwargs | {k: v}))
        return Plan(parts[self.reader.name], tuple(parts[s.name] for s in self.steps), tuple(parts[s.name] for s in self.outputs))

    def without_outputs(self) -> Plan:
        return replace(self, outputs=())

    def featurizer(self) -> Plan:
        """Reader and outputs alone."""
        return replace(self, steps=())

    def section(self, first: str, last: str) -> Plan:
        """The steps from first to last, with reader and outputs."""
        names = [s.name for s in self.steps]
        if first not in names or last not in names:
            raise ValueError("no such step")
        return replace(self, steps=self.steps[names.index(first) : names.index(last) + 1])

    def feature_names(self) -> list[str]:
        """Of the vector outputs, with the output's name before each."""
        return [f"{s.name}__{n}" for s in self.outputs for n in _names(s.op, s.kwargs)]

    def equivalent(self, other: Plan) -> bool:
        """Whether two plans do the same, whatever their steps are called."""
        bare = lambda p: [(s.op, json.dumps(s.kwargs, sort_keys=True)) for s in (p.reader, *(x for x in p.steps if x.op != "passthrough"), *p.outputs)]
        return bare(self) == bare(other)

    def to_json(self) -> str:
        """ValueError if a parameter is a function: register the step under a name instead."""
        if any(callable(v) for s in (self.reader, *self.steps, *self.outputs) for v in s.kwargs.values()):
            raise ValueError("a function does not go to JSON")
        pack = lambda s: {"name": s.name, "op": s.op, "params": s.kwargs}
        return json.dumps({"reader": pack(self.reader), "steps": [pack(s) for s in self.steps], "outputs": [pack(s) for s in self.outputs]}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Plan:
        d = json.loads(text)
        one = lambda x: Step.of(x["name"], x["op"], **x["params"])
        return Plan(one(d["reader"]), tuple(map(one, d["steps"])), tuple(map(one, d["outputs"])))

    def run_one(self, value) -> tuple[list, dict | None]:
        """Output values (None after an error), and the error; a 'bool' output turns an error into false."""
        read, steps, outputs = self._build()
        return _run_one(self, read, steps, outputs, value)

    def apply(self, df: DataFrame, input_col: str = "input", keep: tuple[str, ...] = ()) -> DataFrame:
        """df: row_id, input -> row_id, keep..., one column an output, err. Stateless, so it runs on streams as well."""
        plan = self
        types = [OUTPUTS[s.op][0] for s in self.outputs]
        names = ["row_id", *keep, *(s.name for s in self.outputs), "err"]
        kinds = [df.schema[c].dataType.simpleString() for c in ("row_id", *keep)]
        schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [*kinds, *types, ERR]))

        # executors do not know what was registered here
        own_steps = [(s.op, MOL_OPS[s.op]) for s in self.steps if s.op in _OWN_STEPS]
        own_outputs = [(s.op, *OUTPUTS[s.op]) for s in self.outputs if s.op in _OWN_OUTPUTS]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in own_steps:
                register_step(*x)
            for x in own_outputs:
                register_output(*x)
            read, steps, outputs = plan._build()
            one = functools.lru_cache(CACHED)(lambda v: _run_one(plan, read, steps, outputs, v))  # tables repeat their molecules
            for b in batches:
                rows = [one(v.as_py()) for v in b.column(len(keep) + 1)]
                cols = [pa.array([r[0][k] for r in rows], _ARROW[t]) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep) + 1], *cols, pa.array([r[1] for r in rows], _ERR_ARROW)], names)

        rows = df.select("row_id", *keep, input_col)
        cores = df.sparkSession.sparkContext.defaultParallelism
        # the kernel costs far more than a shuffle of its inputs: a table too small to be read by every core is dealt over all of them
        if not df.isStreaming and _estimated_bytes(rows) < cores * SPREAD_BYTES:
            rows = rows.repartition(cores)
        return rows.mapInArrow(run, schema)


def _run_one(plan: Plan, read, steps, outputs, value) -> tuple[list, dict | None]:
    err, at = None, plan.reader
    out: list = [None] * len(outputs)
    try:
        m = read(value)
        for at, f in steps:
            m = f(m)
        for k, (at, f) in enumerate(outputs):
            out[k] = f(m)
    except MolError as e:
        err = {"element_id": at.name, "element_name": at.op, "message": str(e)}
        out = [None] * len(outputs)
    for k, (s, _) in enumerate(outputs):
        if s.op == "bool":
            out[k] = err is None
    return out, err
