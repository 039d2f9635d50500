"""Column expressions and kernels; expressions stay within code generation, kernels are plain numpy or Python."""
