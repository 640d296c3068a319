"""A fluent builder of documents, and documents from rows."""

from folium.build.document import DocumentBuilder
from folium.build.style import Length, RunStyleBuilder
from folium.build.table import TableBuilder, table_from_rows

__all__ = ["DocumentBuilder", "Length", "RunStyleBuilder", "TableBuilder", "table_from_rows"]
