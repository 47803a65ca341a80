"""A published summary and an archive become a snapshot that loads."""

import hashlib
import io
import tarfile

import pytest

from plumbline.operators.checks import DataError
from plumbline.plans.converters import convergence_snapshot, formula_parts
from plumbline.sources import readers

HEADER = {"schema_version": 1, "record_id": "r", "snapshot_version": "1", "target": {"name": "k_index", "contract": "c", "units": None}, "features_file": None}
CIFS = {"mp-1": "data_x\n_chemical_formula_sum 'Fe4 O6'\n", "mp-2": 'data_y\n_chemical_formula_sum   "Na1 Cl1"\n', "mp-3": "_chemical_formula_sum Si8\n", "mp-9": "data_z\n"}


def source(tmp_path, labels=(("mp-1", 3), ("mp-2", 0), ("mp-3", 3)), cifs=CIFS):
    text = 'source_db_id,k_index,k_dist_interval,k_mesh\n' + "".join(f'{i},{k},"[1.0, 0.5)","(4, 4, 4)"\n' for i, k in labels)
    (tmp_path / "s.csv").write_text(text)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, content in cifs.items():
            info = tarfile.TarInfo(f"CIF_files/{name}.cif")
            info.size = len(content)
            t.addfile(info, io.BytesIO(content.encode()))
    return str(tmp_path / "s.csv"), str(tmp_path / "a.tar.gz"), str(tmp_path / "out")


def test_snapshot(spark, tmp_path):
    paths = source(tmp_path)
    digests = tuple(hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("s.csv", "a.tar.gz"))
    found = convergence_snapshot(spark, *paths, HEADER, digests)
    assert (found["samples"], found["groups"], found["labels"]) == (3, 3, {0: 1, 3: 2})
    assert (tmp_path / "out" / "id_prop.csv").read_text() == "mp-1,3,Fe2O3\nmp-2,0,ClNa\nmp-3,3,Si\n"
    s = readers.load_snapshot(spark, paths[2], "regression", ("k_index", "c", None), ["groups"])
    assert sorted((r.sample_id, r.target_num, r.group) for r in s.samples.collect()) == [("mp-1", 3.0, "Fe2O3"), ("mp-2", 0.0, "ClNa"), ("mp-3", 3.0, "Si")]
    with pytest.raises(FileExistsError):
        convergence_snapshot(spark, *paths, HEADER)
    with pytest.raises(DataError, match="digest"):
        convergence_snapshot(spark, *paths, HEADER, ("0" * 64, digests[1]))


@pytest.mark.parametrize("labels,message", [([("mp-1", 3), ("mp-8", 1)], "samples_without_formula: 1"), ([("mp-9", 1)], "samples_without_formula: 1"), ([("mp-1", 3), ("mp-1", 2)], "repeated_ids"), ([], "no_labels")])
def test_what_is_refused(spark, tmp_path, labels, message):
    with pytest.raises(DataError, match=message):
        convergence_snapshot(spark, *source(tmp_path, labels), HEADER)
    assert not (tmp_path / "out").exists()


def test_formulas(spark):
    rows = [("a", b"_chemical_formula_sum 'Fe2 O3'"), ("b", b"_chemical_formula_sum 'C0.5 H Fe-3'"), ("c", b"nothing"), ("d", b"_chemical_formula_sum H2.5\n")]
    got = sorted((r.sample_id, r.element, r.amount) for r in formula_parts(spark.createDataFrame(rows, "sample_id string, content binary")).collect() if r.element)
    assert got == [("a", "Fe", 2.0), ("a", "O", 3.0), ("d", "H", 2.5)]
