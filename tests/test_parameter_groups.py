"""mzML files whose spectra refer to parameter groups."""

import base64
import struct
import zlib

import pytest

from spectroloom.sources import spectra


def _array(values, group, kind="d", packed=False):
    raw = struct.pack(f"<{len(values)}{kind}", *values)
    raw = zlib.compress(raw) if packed else raw
    return f'<binaryDataArray><referenceableParamGroupRef ref="{group}"/><binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'


def _file(groups, scans):
    head = "".join(f'<referenceableParamGroup id="{g}">{"".join(f"""<cvParam accession="{a}" value="{v}"/>""" for a, v in terms)}</referenceableParamGroup>' for g, terms in groups.items())
    listed = f'<referenceableParamGroupList count="{len(groups)}">{head}</referenceableParamGroupList>' if groups else ""
    body = "".join(f'<spectrum index="{n - 1}" id="scan={n}"><referenceableParamGroupRef ref="level"/><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>' for n, arrays in scans)
    return f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml">{listed}<run><spectrumList>{body}</spectrumList></run></mzML>'


# two files that give one id to different groups: 64-bit and packed against 32-bit and plain
WIDE = {"level": [("MS:1000511", "2")], "x": [("MS:1000514", ""), ("MS:1000523", ""), ("MS:1000574", "")], "y": [("MS:1000515", ""), ("MS:1000521", "")]}
NARROW = {"level": [("MS:1000511", "1")], "x": [("MS:1000514", ""), ("MS:1000521", "")], "y": [("MS:1000515", ""), ("MS:1000519", "")]}


@pytest.mark.parametrize("most", [5000, 0])
def test_groups_of_each_file(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(spectra, "GROUP_FILES", most)
    wide = [(n, _array([n + 0.1, n + 0.2], "x", packed=True) + _array([1.5, 2.5], "y", "f")) for n in (1, 2, 3)]
    (tmp_path / "wide.mzML").write_text(_file(WIDE, wide))
    (tmp_path / "narrow.mzML").write_text(_file(NARROW, [(1, _array([7.5], "x", "f") + _array([9], "y", "i"))]))
    got = {(r["run"], r["scan_num"]): (r["ms_level"], r["mz"], r["intensity"]) for r in spectra.read_mzml(spark, str(tmp_path)).collect()}
    assert got == {("wide.mzML", n): (2, [n + 0.1, n + 0.2], [1.5, 2.5]) for n in (1, 2, 3)} | {("narrow.mzML", 1): (1, [7.5], [9.0])}


def test_unknown_group(spark, tmp_path):
    (tmp_path / "a.mzML").write_text(_file({}, [(4, "")]))
    row = spectra.read_mzml(spark, str(tmp_path)).first()
    assert (row["scan_num"], row["ms_level"], row["mz"]) == (4, None, [])
