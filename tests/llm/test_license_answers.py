"""License scans on sentences with known answers, none of them taken from the templates."""

import pytest

from loomspark.llm import licenses

ANSWERS = [
    ("We never use the MIT License here and reject it.", None),
    ("The MIT License is shorter than the GPL.", None),
    ("// SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0-only"),
    ("# SPDX-License-Identifier: MIT\n", "MIT"),
    ("This file is part of X. Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1-only"),
    ("Licensed under the" + " " * 2100 + "Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under\n" + "*" * 300 + "\n * the Apache License, Version 2.0.", "Apache-2.0"),
    ("MIT License\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT"),
    ("a word " * 20_000 + "released under the ISC License. " + "more words " * 20_000, "ISC"),
    ("Licensed under the Eclipse Public License 2.0", "EPL-2.0"),
    ("no licence at all, licensed under nothing", None),
    ("", None),
    (None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"d/{i}", text) for i, (text, _) in enumerate(ANSWERS)]
    return {r.file_id: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}


@pytest.mark.parametrize("i", range(len(ANSWERS)))
def test_answer(found, i):
    assert found[i] == ANSWERS[i][1], (ANSWERS[i][0] or "")[:80]
