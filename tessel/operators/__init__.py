"""Relational operators on meshes, cells, planes and solids."""
