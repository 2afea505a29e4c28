"""spectraloom: Spark-native analytics for mass-spectrometry proteomics tables.

Everything is expressed as DataFrame plans; Arrow/pandas functions appear only
where a kernel is inherently sequential.
"""
