"""Column expressions over element types and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vertices of an element by geometry code (point, segment, triangle, square, tetrahedron, cube, prism).
ARITY = {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6}
# Vertices of an element by the codes of the Gmsh MSH 4.1 format, and its topological dimension.
GMSH_ARITY = {1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6, 7: 5, 15: 1}
GMSH_DIMENSION = {15: 0, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 3, 7: 3}

# Local faces of an element by (dimension, vertices), each as positions in its vertex list.
FACES = {
    (2, 3): ((0, 1), (1, 2), (2, 0)),
    (2, 4): ((0, 1), (1, 2), (2, 3), (3, 0)),
    (3, 4): ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)),
    (3, 5): ((0, 1, 2, 3), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)),
    (3, 6): ((0, 1, 2), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)),
    (3, 8): ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)),
}
# Local edges of an element by geometry code.
EDGES = {
    1: ((0, 1),),
    2: ((0, 1), (1, 2), (2, 0)),
    3: ((0, 1), (1, 2), (2, 3), (3, 0)),
    4: ((0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)),
    5: ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)),
    6: ((0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)),
}


def arity(geom_type: Column) -> Column:
    """Vertices of an element of this geometry; 0 for an unknown code."""
    out = F.lit(0)
    for code, n in ARITY.items():
        out = F.when(geom_type == code, n).otherwise(out)
    return out


def element_dofs(geom_type: Column, p: Column) -> Column:
    """Degrees of freedom of order p: triangle, square, tetrahedron, cube; an error for any other geometry."""
    n = p + 1
    return (
        F.when(geom_type == 2, (n * (p + 2) / 2).cast("long"))
        .when(geom_type == 3, (n * n).cast("long"))
        .when(geom_type == 4, (n * (p + 2) * (p + 3) / 6).cast("long"))
        .when(geom_type == 5, (n * n * n).cast("long"))
        .otherwise(F.raise_error(F.lit("no degrees of freedom for this geometry")).cast("long"))
    )


def local_parts(verts: Column, table: tuple[tuple[int, ...], ...]) -> Column:
    """The sub-lists of verts that `table` names."""
    return F.array(*[F.array(*[F.element_at(verts, i + 1) for i in part]) for part in table])


def d2(x: str, y: str, z: str, cx: str = "cx", cy: str = "cy", cz: str = "cz") -> Column:
    """Squared Euclidean distance of two points, given by column names."""
    parts = [(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in ((x, cx), (y, cy), (z, cz))]
    return parts[0] + parts[1] + parts[2]


def cap(ideal: Column | float, factor: float) -> Column:
    """int(factor * ideal + 0.5), cut off toward zero."""
    return (F.lit(factor) * ideal + F.lit(0.5)).cast("long")
