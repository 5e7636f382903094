"""Licences in the layout they are handed out in: the operator and its SQL twin."""

import duckdb
import pytest

from articleflow.llm import licenses, sql

MIT = """MIT License

Copyright (c) 2021 Some Person

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """   Copyright 2020 Some Person

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
TEXTS = {
    1: MIT, 2: APACHE, 3: GPL, 4: BSD_2, 5: BSD_3, 6: "".join("// " + line + "\n" for line in APACHE.splitlines()),
    7: MIT.replace("\n", "\r\n"), 8: MIT[:-400], 9: BSD_3.replace("3. Neither", "some words between. 3. Neither"),
    10: MIT + APACHE + MIT, 11: "Released under the MIT License. All rights reserved.", 12: "1 licensed under the mit license x",
    13: None, 14: "", 15: "iv) Licensed under the MIT license", 16: "a. plain text without any licence " * 400, 17: " ".join(MIT[MIT.index("Permission"):].split()),
}
NAMES = {1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0-or-later", 4: "BSD-2-Clause", 5: "BSD-3-Clause", 6: "Apache-2.0", 7: "MIT",
         8: "", 9: "BSD-2-Clause", 10: "Apache-2.0,MIT", 11: "MIT,All-rights-reserved", 12: "", 13: "", 14: "", 15: "MIT", 16: "",
         17: "MIT"}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in [*TEXTS.items(), (1, MIT)]],
                                 "doc_id long, text string, licenses string, ids string")
    return [tuple(r) for r in licenses.scan(docs).collect()]


def test_licences_in_their_own_layout(found):
    names = {}
    for row in found:
        assert names.setdefault(row[0], row[3]) == row[3]
    assert {i: ",".join(sorted(n.split(","))) for i, n in names.items()} == {
        i: ",".join(sorted(n.split(","))) for i, n in NAMES.items()}
    assert len(found) == len(TEXTS) + 1


def test_twin_finds_the_same(found):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*TEXTS.items(), (1, MIT)])
    assert sorted(con.execute(sql.licenses()).fetchall()) == sorted(found)
