"""Operators for preparing training text. Nothing outside this subpackage imports it.

All of them: columns other than those named are not read, so their names cannot clash; empty tables give empty results of the
same columns; texts are read whole whatever their length. Rows without an id take part in all counts; where a result is put
together by id they are left out.
"""
