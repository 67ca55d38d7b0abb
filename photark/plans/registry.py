"""All registered queries outside the training-data subpackage."""

from photark.plans import catalog, colors, files, glyphs, images, items, library, library_api, rasters, stacks, stored

QUERIES = catalog.QUERIES | colors.QUERIES | files.QUERIES | glyphs.QUERIES | images.QUERIES | items.QUERIES | library.QUERIES | library_api.QUERIES | rasters.QUERIES | stacks.QUERIES | stored.QUERIES
SQL = catalog.SQL | colors.SQL | files.SQL | glyphs.SQL | images.SQL | items.SQL | library.SQL | library_api.SQL | rasters.SQL | stacks.SQL | stored.SQL
