"""The extraction job: source files to one row of facts per file.

A file is read where it lies: no shuffle before or after. Facts of a file stay nested in
its row; the flat tables in ``views`` are narrow projections of it.
"""

import gc
import multiprocessing
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sourcequarry import schema
from sourcequarry.operators import module_reader

# Workers get the reader inside the task, so they need no installed package.
cloudpickle.register_pickle_by_value(module_reader)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODES = ("intended", "reference")
ON_ERROR = ("row", "fail", "sanitize")
#: Files read at a time, and bytes of their texts (one file at least).
FILES_AT_A_TIME, TEXT_AT_A_TIME = 256, 8 << 20
RECORDS = ("docstring", "entities", "scopes", "imports", "node_map")
LIGHT_RECORDS = ("counts",)         # only where asked for by name


def extract_facts(
    source_files: DataFrame,
    *,
    records: Sequence[str] = RECORDS,
    with_source: bool = True,
    mode: str = "intended",
    on_error: str = "row",
    include_async: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per source file, with the chosen ``records`` as nested columns.

    ``mode="reference"`` keeps the gaps of the original behaviour (no methods, no default
    values, relationship lookup by bare name). A file that does not parse gives a row with
    ``error`` and empty records (``on_error="row"``), ends the job (``"fail"``), or also
    gets a node map from its readable lines (``"sanitize"``). Columns named in ``carry``
    pass through unread. The record ``counts`` is all that statistics need.
    """
    if mode not in MODES or on_error not in ON_ERROR:
        raise ValueError(f"mode must be one of {MODES} and on_error one of {ON_ERROR}")
    unknown = set(records) - {*RECORDS, *LIGHT_RECORDS}
    if unknown:
        raise ValueError(f"unknown records: {sorted(unknown)}")

    wanted = ["error", "n_lines_removed", *(r for r in (*RECORDS, *LIGHT_RECORDS) if r in records)]
    keys = ["repo_id", "rel_path", *carry, *(["raw_code"] if with_source else [])]
    files = source_files.select("repo_id", "rel_path", *carry, F.col("content").alias("raw_code"))
    fields = {f.name: f for f in [*files.schema.fields, *schema.MODULE_FACTS.fields, T.StructField("counts", schema.COUNTS)]}
    out_schema = T.StructType([fields[name] for name in keys + wanted])
    arrow_types = {name: to_arrow_type(fields[name].dataType) for name in wanted}
    options = dict(records=set(records), mode=mode, on_error=on_error, include_async=include_async)

    def read(texts):
        for part in _slices(texts):
            with module_reader.quiet_and_quick():
                readings = [module_reader.read_module(text, **options) for text in part.column("raw_code").to_pylist()]
                columns = [pa.array([getattr(r, name) for r in readings], arrow_types[name]) for name in wanted]
            yield pa.RecordBatch.from_arrays(columns, names=wanted)

    def read_batches(batches):
        for batch in batches:
            at = 0
            for found in _in_own_process(read, batch.select(["raw_code"])):
                part = batch.slice(at, found.num_rows)
                at += found.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in keys), *found.columns], names=keys + wanted)

    return files.mapInArrow(read_batches, out_schema)


def _in_own_process(
    read: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], texts: pa.RecordBatch,
) -> Iterator[pa.RecordBatch]:
    """``read(texts)`` in a process that ends with them. Python keeps every name it has parsed until
    its process ends, so a worker that parsed by itself would grow with all the files it ever reads."""
    processes = multiprocessing.get_context("fork")
    receiver, sender = processes.Pipe(duplex=False)
    reader = processes.Process(target=_send, args=(read, texts, receiver, sender), daemon=True)
    reader.start()
    sender.close()
    try:
        while (message := receiver.recv()) is not None:
            if isinstance(message, Exception):
                raise message
            with pa.ipc.open_stream(receiver.recv_bytes()) as stream:
                yield from stream
    except EOFError:
        reader.join()
        raise RuntimeError(f"the process that reads source texts ended with {reader.exitcode}") from None
    finally:
        receiver.close()
        reader.terminate()
        reader.join()
        reader.close()


def _send(read, texts, receiver, sender) -> None:
    """What ``read`` gives or raises, and None at the end."""
    receiver.close()  # so that nothing is left to write to once the worker has gone
    gc.disable()  # nothing read here holds a cycle, and what the worker holds need not be looked through
    try:
        for found in read(texts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, found.schema) as stream:
                stream.write_batch(found)
            sender.send(True)
            sender.send_bytes(sink.getvalue())
        sender.send(None)
    except OSError:
        pass  # nobody listens any more
    except Exception as problem:
        sender.send(problem)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of files of bounded number and size."""
    sizes = [n or 0 for n in pc.binary_length(batch.column("raw_code")).to_pylist()]
    first = held = 0
    for at, size in enumerate(sizes):
        if at > first and (held + size > TEXT_AT_A_TIME or at - first == FILES_AT_A_TIME):
            yield batch.slice(first, at - first)
            first, held = at, 0
        held += size
    if batch.num_rows:
        yield batch.slice(first)
