"""Tests of the text operators; a package, so that its conftest does not hide the one above."""
