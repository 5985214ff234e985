"""imzML as a Spark data source: spark.read.format("imzml").load(path), and a writer of processed-mode files.

The XML names each spectrum's place in the binary file beside it.  Partitions are ranges of spectra; each task opens
the binary file for itself and seeks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Accessions of the format's vocabulary.
X, Y, OFFSET, LENGTH = "IMS:1000050", "IMS:1000051", "IMS:1000102", "IMS:1000103"
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
KINDS = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}
SCHEMA = "pixel_id long, x int, y int, mz array<double>, intensity array<float>"


def spectra_of(path: str) -> Iterator[tuple]:
    """(x, y, (offset, length, kind) of m/z, the same of intensity) of each spectrum, in the order of the file."""
    groups: dict = {}
    local = lambda e: e.tag.rpartition("}")[2]

    def params(e) -> dict:
        found = {}
        for child in e.iter():
            name = local(child)
            if name == "cvParam":
                found[child.get("accession")] = child.get("value")
            elif name == "referenceableParamGroupRef":
                found |= groups.get(child.get("ref"), {})
        return found

    for _, e in ElementTree.iterparse(path, events=("end",)):
        name = local(e)
        if name == "referenceableParamGroup":
            groups[e.get("id")] = params(e)
        elif name == "spectrum":
            own, arrays = {}, {}
            for child in e.iter():
                if local(child) == "scan":
                    own |= params(child)
                elif local(child) == "binaryDataArray":
                    p = params(child)
                    kind = next((k for a, k in KINDS.items() if a in p), "<f4")
                    arrays[MZ_ARRAY if MZ_ARRAY in p else INTENSITY_ARRAY] = (int(p[OFFSET]), int(p[LENGTH]), kind)
            yield int(own[X]), int(own[Y]), arrays[MZ_ARRAY], arrays[INTENSITY_ARRAY]
            e.clear()


class _Range(InputPartition):
    def __init__(self, first: int, rows: list):
        self.first, self.rows = first, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stride, self.size = options["path"], int(options.get("stride", 1)), int(options.get("spectra_per_partition", 2000))

    def partitions(self) -> list:
        rows = [r for k, r in enumerate(spectra_of(self.path)) if k % self.stride == 0]
        return [_Range(s, rows[s : s + self.size]) for s in range(0, len(rows), self.size)] or [_Range(0, [])]

    def read(self, partition) -> Iterator:
        with open(self.path.rpartition(".")[0] + ".ibd", "rb") as f:
            def values(at: tuple) -> np.ndarray:
                f.seek(at[0])
                return np.frombuffer(f.read(at[1] * np.dtype(at[2]).itemsize), at[2])

            for s in range(0, len(partition.rows), 256):
                part = partition.rows[s : s + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(partition.first + s, partition.first + s + len(part)), pa.int64()), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()),
                        pa.array([values(r[2]).astype(float) for r in part], pa.list_(pa.float64())), pa.array([values(r[3]).astype(np.float32) for r in part], pa.list_(pa.float32())),
                    ],
                    ["pixel_id", "x", "y", "mz", "intensity"],
                )


class ImzML(DataSource):
    """Options: stride (every n-th spectrum), spectra_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "imzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImzML)


def write(spectra: DataFrame, path: str) -> None:
    """spectra(x, y, mz, intensity) as one processed-mode file: rows come by turns, no more than one partition at once.

    The format is one file, so its writer is one process; everything before it is Spark's.
    """
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1">\n<fileDescription><fileContent>'
        '<cvParam cvRef="IMS" accession="IMS:1000080" name="universally unique identifier" value="{u}"/><cvParam cvRef="IMS" accession="IMS:1000031" name="processed" value=""/></fileContent></fileDescription>\n'
        '<referenceableParamGroupList count="2"><referenceableParamGroup id="mzArray"><cvParam cvRef="MS" accession="MS:1000514" name="m/z array"/><cvParam cvRef="MS" accession="MS:1000523" name="64-bit float"/></referenceableParamGroup>'
        '<referenceableParamGroup id="intensities"><cvParam cvRef="MS" accession="MS:1000515" name="intensity array"/><cvParam cvRef="MS" accession="MS:1000521" name="32-bit float"/></referenceableParamGroup></referenceableParamGroupList>\n<run id="run"><spectrumList>\n'
    )
    array = '<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{r}"/><cvParam cvRef="IMS" accession="IMS:1000102" value="{o}"/><cvParam cvRef="IMS" accession="IMS:1000103" value="{n}"/><cvParam cvRef="IMS" accession="IMS:1000104" value="{b}"/><binary/></binaryDataArray>'
    own = uuid.uuid4()
    with open(path, "w") as xml, open(path.rpartition(".")[0] + ".ibd", "wb") as ibd:
        xml.write(head.format(u=own.hex))
        ibd.write(own.bytes)
        for k, r in enumerate(spectra.select("x", "y", "mz", "intensity").toLocalIterator()):
            parts = []
            for name, values in (("mzArray", np.asarray(r["mz"], "<f8")), ("intensities", np.asarray(r["intensity"], "<f4"))):
                parts.append(array.format(r=name, o=ibd.tell(), n=len(values), b=values.nbytes))
                ibd.write(values.tobytes())
            xml.write(f'<spectrum id="s{k}" index="{k}"><scanList><scan><cvParam accession="{X}" value="{r["x"]}"/><cvParam accession="{Y}" value="{r["y"]}"/></scan></scanList><binaryDataArrayList count="2">{"".join(parts)}</binaryDataArrayList></spectrum>\n')
        xml.write("</spectrumList></run></mzML>\n")
