"""The box every part of the star schema turns into."""

# Corner numbers of the twelve triangles of a box: bit 0 is x, bit 1 is y, bit 2 is z.
# Entry 12 repeats triangle 0 (a pinch), entry 13 is a collapsed triangle.
BOX = (
    (0, 3, 1), (0, 2, 3), (4, 7, 6), (4, 5, 7), (0, 5, 4), (0, 1, 5), (2, 7, 3),
    (2, 6, 7), (0, 6, 2), (0, 4, 6), (1, 7, 5), (1, 3, 7), (0, 3, 1), (0, 1, 1),
)
