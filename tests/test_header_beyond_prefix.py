"""Headers whose rows and columns lie beyond the first HEADER_BYTES."""

import struct

import numpy as np

from rasterloom.sources import codecs, files


def test_large_element_before_the_size(tmp_path):
    whole = codecs.encode_dicom(np.arange(12.0).reshape(3, 4))
    at = whole.index(b"\x28\x00\x02\x00US")
    size = 3 * files.HEADER_BYTES
    path = tmp_path / "a.dcm"
    path.write_bytes(whole[:at] + b"\x09\x00\x10\x10OB\x00\x00" + struct.pack("<I", size) + bytes(size) + whole[at:])
    row = tuple(next(files._Reader({"path": str(path)}, header=True).read(files._Files([str(path)]))).to_pylist()[0].values())
    assert row[1:3] == (3, 4)
