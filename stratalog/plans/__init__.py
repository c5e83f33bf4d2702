"""The store that ties tables to operators, and the registered queries with their checking SQL."""
