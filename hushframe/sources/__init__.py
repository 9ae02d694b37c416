"""Sources and sinks: file catalog, delimited tables, text files, exports."""
