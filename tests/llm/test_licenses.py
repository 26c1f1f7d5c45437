from compare import compare, connect

from eventloom.llm.licenses import op9_licenses, scan
from eventloom.llm.registry import ORACLES

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    assert compare(op9_licenses(spark, SF), connect(SF), ORACLES["op9_licenses"]) is None


def test_cases(spark):
    rows = [("Foo bar.\nReleased under the MIT License.", 1), ("All rights reserved. Licensed under CC BY-NC 4.0.", 1),
            (None, 1), ("", 1), ("the license of a driver", 1), ("word " * 50_000, 1)]
    got = scan(spark.createDataFrame(rows, "text string, n_sentences int")).collect()
    assert [r.licenses for r in got] == ["MIT", "CC-BY-NC-4.0,proprietary", "", "", "", ""]
    assert scan(spark.createDataFrame([], "text string")).count() == 0


MIT = """The MIT License (MIT)

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""
GPL = """This work is licensed under the GNU General
Public License, version 3, see LICENSE."""


def test_wrapped_texts(spark):
    def marked(text: str, mark: str) -> str:
        return "".join(mark + line + "\n" for line in text.split("\n"))

    cases = [(MIT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0"),
             (BSD3 + "\n" + BSD2, "BSD-2-Clause,BSD-3-Clause")]
    rows = [(marked(text, mark), want) for text, want in cases for mark in ("", "# ", " * ", "// ")]
    rows += [(text.replace("\n", "\r\n"), want) for text, want in cases]
    rows += [("Released under the MIT license, see LICENSE", "MIT"), ("It is not licensed under the MIT license.", ""),
             ("SPDX-License-Identifier: MIT-0", ""), ("Licensed under the\n\nMIT license", ""), ("unlicensed under the MIT licenses", ""),
             ("Title\nLicensed under the MIT License\nmore text", "MIT")]
    got = scan(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string")).collect()
    for r in got:
        assert r.licenses == rows[r.i][1], rows[r.i]
