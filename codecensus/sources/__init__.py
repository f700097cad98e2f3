"""Sources and sinks: the ``files`` table, exploded ``lines``, snapshot JSON."""
